"""The pipeline stage by stage against plain versions."""

import corpus_pipeline
from cohortmill.llm import bpe
from cohortmill.llm.queries import tokenizer_path
from tests.llm.test_operators import SF, plain_join


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages)[-1].startswith("BPE") and 4 <= len(stages) <= 5

    good = stages["quality classifier"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    assert good.columns == docs.columns
    assert good.join(labels, "doc_id").count() >= 0.95 * docs.join(labels, "doc_id").count()

    unique = stages["exact dedup"](spark, docs, SF).cache()
    keys = {"".join(c for c in t if c not in " \t\n\v\f\r") for t in texts.values()}
    assert unique.columns == docs.columns and unique.count() == len(keys)

    apart = stages["n-gram Jaccard join"](spark, unique, SF)
    rows = [(r["doc_id"], r["text"]) for r in unique.collect()]
    sets, near = plain_join(rows)
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        label = {i: min([label[i], *(label[j] for j in near[i])]) for i in sets}
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i in sets if label[i] == i)

    mixed = stages["mixing sources to target weights"](spark, docs, SF).cache()
    assert mixed.columns == docs.columns and 0.6 * docs.count() < mixed.count() < 1.5 * docs.count()

    tokens = stages["BPE encoding and decoding"](spark, mixed, SF)
    vocabulary = bpe.vocabulary(tokenizer_path())
    assert all(vocabulary.decode(bytes(r["token_ids"])) == texts[r["doc_id"]] for r in tokens.collect())

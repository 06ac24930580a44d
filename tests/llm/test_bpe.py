"""Encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortmill.llm import bpe
from cohortmill.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("aaabeinrst  '\n\té́ \x1c\x85\xa0019.-")),
                         st.characters(codec="utf-8")), max_size=60))
def test_any_text(library, text):
    vocabulary = bpe.vocabulary(tokenizer_path())
    want = library.encode(text, add_special_tokens=False).ids
    assert vocabulary.encode_all([text]) == [packed(want)]
    assert vocabulary.decode(packed(want)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_any_ids(library, ids):
    assert bpe.vocabulary(tokenizer_path()).decode(packed(ids)) == library.decode(
        ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeinorst", min_size=1, max_size=40))
def test_speculated_words_are_exact(text):
    vocabulary = bpe.vocabulary(tokenizer_path())
    vocabulary.cache.clear()
    assert vocabulary.encode_all([text])[0] == packed(vocabulary.merged(text.encode()))


def test_long_runs_and_specials(library, monkeypatch):
    vocabulary = bpe.vocabulary(tokenizer_path())
    texts = ["a" * 5001, " " * 3000 + "x", "ab" * 2000, "x<|endoftext|> y<|endoftext|><|endof", "", "word " * 3000]
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 1000)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    want = [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert vocabulary.encode_all(texts) == want


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op7_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        row = got[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(
            library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_clashes_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "hi hi", "z"), (2, "hi hi", "z")],
                                 "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(rows, tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in got) == [
        (0, 0, ""), (1, 0, ""), (2, 8, "hi hi"), (2, 8, "hi hi")]
    assert bpe.encode(rows.limit(0), tokenizer_path()).collect() == []

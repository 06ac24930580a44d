"""Files that arrive over time: parsed once, checked, committed once."""

import pytest
from pyspark.errors import StreamingQueryException

from cohortmill.streaming import ingest
from tests.conftest import rows_as
from tests.test_sources import star_text

NAME = "{}.rna_seq.augmented_star_gene_counts.tsv"


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, text):
        (tmp_path / "in" / NAME.format(name)).write_text(text)

    return put, (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))


def sums(spark, out):
    return rows_as(ingest.accepted_rows(spark, out).groupBy("file").sum("unstranded"))


def test_each_file_is_read_once(spark, place):
    put, folders = place
    put("a", star_text([1, 2, 3]))
    ingest.ingest_new_files(spark, *folders)
    put("b", star_text([4, 5, 6]))
    for _ in range(2):
        ingest.ingest_new_files(spark, *folders)
    assert sums(spark, folders[1]) == [("a", 6), ("b", 15)]
    assert rows_as(ingest.ledger(spark, folders[1]), "file", "status", "n_rows", "batch") == [
        ("a", "accepted", 3, 0), ("b", "accepted", 3, 1)]


def test_bad_files_land_in_quarantine(spark, place):
    put, folders = place
    put("good", star_text([1, 2, 3]))
    put("foreign", star_text([1, 2, 3], ("ENSG1", "LRG17", "ENSG2")))
    put("twice", star_text([1, 2, 3], ("ENSG1", "ENSG1", "ENSG2")))
    put("broken", star_text(["1", "2.5", "x"]))
    put("empty", star_text([]))
    ingest.ingest_new_files(spark, *folders, files_per_batch=2)
    got = {r["file"]: r for r in ingest.ledger(spark, folders[1]).collect()}
    assert {f: r["status"] for f, r in got.items()} == {
        "good": "accepted", "foreign": "quarantined", "twice": "quarantined", "broken": "quarantined"}
    assert (got["foreign"]["n_foreign"], got["foreign"]["example"]) == (1, "LRG17")
    assert (got["twice"]["n_repeated"], got["broken"]["n_malformed"]) == (1, 6)  # two values in two columns of counts and one of measures
    assert sums(spark, folders[1]) == [("good", 6)]
    held = spark.read.parquet(folders[1] + "/quarantine")
    assert rows_as(held.groupBy("file").count()) == [("broken", 3), ("foreign", 3), ("twice", 3)]


def test_a_batch_run_again_adds_nothing(spark, place):
    put, folders = place
    put("a", star_text([1, 2, 3]))
    put("b", star_text([4, 5, 6], ("ENSG1", "X123", "ENSG2")))
    failing = [True]

    def once_failing(text, batch, out, modality):
        ingest.commit_batch(text, batch, out, modality)
        if failing:
            raise RuntimeError("lost after the rows were written")

    with pytest.raises(StreamingQueryException):
        ingest.ingest_new_files(spark, *folders, commit=once_failing)
    assert sums(spark, folders[1]) == [("a", 6)]
    failing.clear()
    ingest.ingest_new_files(spark, *folders, commit=once_failing)
    assert sums(spark, folders[1]) == [("a", 6)] and ingest.ledger(spark, folders[1]).count() == 2


def test_rows_of_a_batch_that_was_not_committed_are_not_seen(spark, place):
    put, folders = place
    put("a", star_text([1, 2, 3]))
    ingest.ingest_new_files(spark, *folders)
    ingest.accepted_rows(spark, folders[1]).write.parquet(folders[1] + "/rows/batch=7")
    assert sums(spark, folders[1]) == [("a", 6)]


def test_a_name_delivered_again_is_not_kept_twice(spark, place, tmp_path):
    put, folders = place
    put("a", star_text([1, 2, 3]))
    ingest.ingest_new_files(spark, *folders)
    (tmp_path / "in" / "later").mkdir()
    put("later/a", star_text([7, 7, 7]))
    ingest.ingest_new_files(spark, *folders)
    assert sums(spark, folders[1]) == [("a", 6)]
    assert rows_as(ingest.ledger(spark, folders[1]), "file", "status") == [("a", "accepted"), ("a", "repeated")]

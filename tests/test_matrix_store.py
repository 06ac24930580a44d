"""A matrix kept up to date equals the one built from all files at once."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import matrix as M
from cohortmill.operators import matrix_store as MS
from tests.conftest import rows_as

NAME = "{}.rna_seq.augmented_star_gene_counts.tsv"
# sample, depth of each of its files: ties, a deeper second file, a shallower one, single files
FILES = {"a1": ("A", 5), "a2": ("A", 9), "b1": ("B", 7), "b2": ("B", 7), "c1": ("C", 8), "c2": ("C", 3), "d2": ("D", 4), "e1": ("E", 6)}


@pytest.fixture
def files(spark):
    rows = [(NAME.format(name), f"ENSG{g}", depth + g) for name, (_, depth) in FILES.items() for g in range(4)]
    quant = spark.createDataFrame(rows, "file_name string, gene_id string, unstranded bigint")
    sheet = spark.createDataFrame([(NAME.format(n), s, i) for i, (n, (s, _)) in enumerate(FILES.items())],
                                  "file_name string, sample_id string, position int")
    return quant, sheet


def only(quant, last):
    return quant.where(F.substring("file_name", 2, 1).isin(*last))


def states(path):
    return {p.parent.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.parent.glob("*.parquet")) for p in Path(path).glob("*/*.parquet")}


@pytest.mark.parametrize("strategy", ["deepest", "first"])
@pytest.mark.parametrize("order", ["12", "21"])
def test_added_files_give_the_matrix_of_all(spark, files, tmp_path, strategy, order):
    quant, sheet = files
    path = str(tmp_path / "matrix")
    want = rows_as(M.build_matrix(quant, sheet, "counts", strategy).withColumn("value", F.col("value").cast("double")))
    MS.create(MS.sample_cells(only(quant, order[0]), sheet, "counts", strategy), path, 16)
    outcome = rows_as(MS.add(MS.sample_cells(only(quant, order[1]), sheet, "counts", strategy), path, strategy, 16), "sample_id", "outcome")
    assert rows_as(MS.stored_cells(spark, path)) == want
    if (strategy, order) == ("deepest", "12"):
        assert outcome == [("A", "replaced"), ("B", "kept"), ("C", "kept"), ("D", "new")]
    again = rows_as(MS.add(MS.sample_cells(quant, sheet, "counts", strategy), path, strategy, 16), "outcome")
    assert set(again) == {("kept",)} and rows_as(MS.stored_cells(spark, path)) == want


def test_other_folders_keep_their_files(spark, files, tmp_path):
    quant, sheet = files
    path = str(tmp_path / "matrix")
    MS.create(MS.sample_cells(only(quant, "1"), sheet, "counts", "deepest"), path, 64)
    before = states(path)
    MS.add(MS.sample_cells(only(quant, "2"), sheet, "counts", "deepest"), path, "deepest", 64)
    after = states(path)
    folder = {r[0]: f"bucket={r[1]}" for r in spark.createDataFrame([(s,) for s in "ABCDE"], "sample_id string").select(
        "sample_id", MS._bucket(64)).collect()}
    changed = {folder["A"], folder["D"]}
    assert {f for f in after if before.get(f) != after[f]} == changed
    assert all(after[folder[s]] == before[folder[s]] for s in "BCE" if folder[s] not in changed)


def test_two_files_of_a_sample_can_be_an_error(spark, files, tmp_path):
    quant, sheet = files
    path = str(tmp_path / "matrix")
    MS.create(MS.sample_cells(only(quant, "1"), sheet, "counts", "fail"), path)
    with pytest.raises(ValueError, match="several files"):
        MS.add(MS.sample_cells(only(quant, "2"), sheet, "counts", "fail"), path)
    with pytest.raises(ValueError, match="without a sample sheet row"):
        MS.sample_cells(quant.withColumn("file_name", F.lit("other.tsv")), sheet, "counts", "first")

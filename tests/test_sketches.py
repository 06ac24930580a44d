"""Sketches that grow batch by batch against exact ranks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import export as E
from cohortmill.operators import sketches as Q
from cohortmill.sources import sinks
from tests.conftest import rows_as

POINTS = {"p1": 0.01, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}


def off(values, estimate, p):
    """How far the estimate's ranks (ties give a range) are from the wanted one, as a share."""
    ranked = np.sort(values)
    low, high = np.searchsorted(ranked, estimate, "left") / len(ranked), np.searchsorted(ranked, estimate, "right") / len(ranked)
    return max(low - p, p - high, 0.0)


def test_batches_merge_within_the_bound(spark, tmp_path):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"f": rng.choice(["hot", "a", "b"], 60_000, p=[0.8, 0.15, 0.05]), "value": rng.lognormal(0, 2, 60_000)})
    pdf.loc[::3, "value"] = 0.0
    pdf.loc[::1000, "value"] = np.nan
    path = str(tmp_path / "sketches")
    for number, part in enumerate(np.array_split(pdf, 3)):
        Q.add_sketches(spark.createDataFrame(part), path, ["f"], str(number))
    Q.add_sketches(spark.createDataFrame(np.array_split(pdf, 3)[2]), path, ["f"], "2")  # the last one again
    got = {r["f"]: r for r in Q.sketch_quantiles(Q.stored_sketches(spark, path), ["f"], POINTS).collect()}
    for f, values in pdf.dropna().groupby("f").value:
        assert got[f]["n"] == len(values)
        assert max(off(values, got[f][name], p) for name, p in POINTS.items()) <= Q.rank_error()


def test_groups_without_values_have_no_row(spark):
    cells = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 2.0)], "f string, value double")
    assert rows_as(Q.sketch_quantiles(Q.sketch_values(cells, ["f"]), ["f"], {"m": 0.5})) == [("c", 1, 2.0)]
    assert Q.sketch_quantiles(Q.sketch_values(cells.limit(0), ["f"]), ["f"], {"m": 0.5}).count() == 0


# ---- manifests --------------------------------------------------------------------------

def test_manifests_name_what_differs(spark, dataset, tmp_path):
    cells = dataset[1]
    sources = spark.createDataFrame([("x.tsv", "1"), ("y.tsv", "2")], "file string, md5 string")
    sample, feature = cells.agg(F.max("sample_id"), F.max("feature_id")).first()
    hit = (F.col("sample_id") == sample) & (F.col("feature_id") == feature)
    other = cells.withColumn("value", F.when(hit, 1234.5).otherwise(F.col("value")))

    def manifest(rows, files, name):
        sinks.write_manifest_tables(E.manifest_tables(rows, "tpm", files), str(tmp_path / name))
        return sinks.read_manifest_tables(spark, str(tmp_path / name), "features", "samples", "sources")

    one = manifest(cells, sources, "one")
    assert E.compare_manifests(one, manifest(cells.repartition(7).orderBy("value"), sources, "same")).count() == 0
    found = E.compare_manifests(one, manifest(other, sources.where("md5 = '1'"), "two"))
    assert rows_as(found) == [("features", feature, "changed"), ("sources", "y.tsv\t2", "only_left")]
    changed = E.changed_cells(cells, other, found).collect()
    assert [(r["feature_id"], r["sample_id"], r["after"]) for r in changed] == [(feature, sample, 1234.5)]
    assert one["samples"].count() == cells.select("sample_id").distinct().count()
    fewer = E.compare_manifests(one, manifest(cells.where(F.col("sample_id") != sample), sources, "fewer"))
    assert fewer.where("table = 'samples' and status = 'only_left'").count() == 1
    assert fewer.where("table = 'features' and status = 'changed'").count() == cells.select("feature_id").distinct().count()


def test_a_changed_value_of_any_kind_changes_the_digest(spark):
    kind = "sample_id string, feature_id string, value double"
    rows = [("s", "f", 1.0), ("t", "f", None), ("s", "g", 0.0)]
    base = {r["feature"]: r["digest"] for r in E.feature_digests(spark.createDataFrame(rows, kind)).collect()}
    for change in ([("s", "f", None), ("t", "f", 1.0)], [("s", "f", 1.0)], [("s", "f", 1.0), ("t", "f", 0.0)],
                   [("s", "f", 1.0), ("t", "f", None), ("t", "f", None)]):
        got = {r["feature"]: r["digest"] for r in E.feature_digests(spark.createDataFrame([*change, rows[2]], kind)).collect()}
        assert got["f"] != base["f"] and got["g"] == base["g"]

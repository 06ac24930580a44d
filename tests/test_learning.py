"""Leakage rules of the export, readiness statuses, manifests and many-test correction."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.functions.fixed import SIGNATURE_PANEL
from cohortmill.operators import export as E
from cohortmill.operators import readiness as R
from cohortmill.operators import testing as T
from cohortmill.plans import builds
from cohortmill.sources import sinks
from tests import reference_math
from tests.conftest import N_CASES, N_FEATURES, N_SAMPLES, SECOND_SAMPLES, rows_as

OPTIONS = dict(top_k=20, test_share=0.25, seed=42)


@pytest.fixture(scope="module")
def made(dataset):
    return E.prepare_export(*dataset, **OPTIONS)


def test_no_case_on_both_sides(dataset, made):
    assert made.manifest["split"]["no_leakage"] and made.manifest["split"]["shared_cases"] == 0
    train, test = ({r[0] for r in made.y(side).select("case_id").collect()} for side in (False, True))
    assert train and test and not train & test
    whole = E.prepare_export(*dataset, one_per_case=False, **OPTIONS)
    assert whole.manifest["split"]["no_leakage"] and not whole.manifest["rows"]["deepest_per_case"]


def test_one_sample_per_case(made):
    rows = made.manifest["rows"]
    assert rows["kept"] == N_CASES < rows["read"] == N_SAMPLES
    assert made.labels.groupBy("case_id").count().where("count > 1").isEmpty()


def test_train_is_standardized_and_test_is_not(made):
    stats = made.cells.groupBy("is_test", "feature_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    train = stats.where("not is_test").toPandas()
    assert np.abs(train.m).max() < 1e-8 and np.abs(train.s - 1).max() < 1e-8
    assert np.abs(stats.where("is_test").toPandas().m).max() > 1e-8


def test_test_values_do_not_reach_train(dataset, made):
    cohort, cells = dataset
    tests = made.y(True).select("sample_id")
    moved = cells.join(tests.withColumn("t", F.lit(True)), "sample_id", "left").select(
        "sample_id", "feature_id", F.when(F.col("t"), F.col("value") * 1000 + 500).otherwise(F.col("value")).alias("value"))
    # the deepest sample of a case stays the same: all its samples move together
    after = E.prepare_export(cohort, moved, **OPTIONS)
    assert after.feature_names() == made.feature_names()
    before_x = made.cells.where("not is_test").toPandas().sort_values(["sample_id", "feature_id"])
    after_x = after.cells.where("not is_test").toPandas().sort_values(["sample_id", "feature_id"])
    assert list(before_x.sample_id) == list(after_x.sample_id) and np.allclose(before_x.x, after_x.x)


def test_selection(made):
    assert len(made.feature_names()) == 20
    chosen = made.manifest["features"]
    assert chosen["constant"] == 2 and chosen["kept"] == 20
    assert made.x(False).columns == made.x(True).columns


def test_same_seed_same_split(dataset, made):
    cohort = dataset[0]
    again = E.prepare_export(*dataset, **OPTIONS)
    assert rows_as(again.labels) == rows_as(made.labels)
    one, two = (rows_as(E.case_split(cohort, 0.25, s)) for s in (1, 2))
    assert one != two
    moved = rows_as(E.case_split(cohort.repartition(13), 0.25, 1))
    assert moved == one


def test_split_sizes_per_stratum(dataset):
    rows = E.case_split(dataset[0], 0.25, 3).groupBy("stratum").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r["t"] == round(r["n"] * 0.25) for r in rows)


def test_errors(dataset):
    with pytest.raises(ValueError, match="empty"):
        E.prepare_export(*dataset, test_share=0.0)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_bundle(spark, made, tmp_path, fmt):
    sinks.write_export(made, str(tmp_path), fmt)
    folders = {p.name for p in tmp_path.iterdir()}
    assert folders == {f"X_train.{fmt}", f"X_test.{fmt}", f"y_train.{fmt}", f"y_test.{fmt}", "selected_features", "manifest"}
    names = [r[0] for r in spark.read.text(str(tmp_path / "selected_features")).collect()]
    assert names == made.feature_names()
    manifest = json.loads(spark.read.text(str(tmp_path / "manifest")).first()[0])
    assert manifest["export"]["format"] == fmt and "folds_by_case" in manifest["notes"]
    if fmt == "parquet":
        assert spark.read.parquet(str(tmp_path / "X_train.parquet")).columns == ["sample_id", *names]


def test_unknown_format(made, tmp_path):
    with pytest.raises(ValueError, match="unknown format"):
        sinks.write_export(made, str(tmp_path), "xlsx")


def test_digest_ignores_order_but_not_values(spark, dataset):
    cells = dataset[1]
    one = E.matrix_manifest(cells, "tpm").first()
    two = E.matrix_manifest(cells.repartition(9).orderBy("value"), "tpm").first()
    assert one == two and one["n_cells"] == N_SAMPLES * N_FEATURES
    other = E.matrix_manifest(cells.withColumn("value", F.col("value") + 1), "tpm").first()
    assert other["content_hash"] != one["content_hash"] and other["samples_hash"] == one["samples_hash"]


# ---- readiness ------------------------------------------------------------------------

def report_of(cohort, cells, metric=None):
    return {r["measure"]: r for r in R.readiness(
        R.cohort_measures(cohort), R.feature_measures(cells), metric).collect()}


def test_readiness(dataset):
    cohort, cells = dataset
    rows = report_of(cohort, cells, "TPM")
    assert rows["n_samples"]["value"] == N_SAMPLES and rows["n_samples"]["status"] == "yellow"
    assert rows["metric"]["status"] == "green" and rows["zero_variance"]["value"] == 2
    assert rows["repeated_cases"]["value"] == SECOND_SAMPLES and rows["repeated_cases"]["status"] == "red"
    assert rows["completeness"]["status"] == "green" and rows["n_sites"]["value"] == 3
    for metric, status, action in (("counts", "red", "normalise_counts"), ("FPKM", "yellow", "convert_to_tpm"),
                                   ("FPKM/other", "yellow", "convert_to_tpm"), ("other", "yellow", "confirm_metric")):
        row = report_of(cohort, cells, metric)["metric"]
        assert (row["status"], row["action"]) == (status, action)
    assert "metric" not in report_of(cohort, cells)


def test_empty_field_is_red(dataset):
    cohort, cells = dataset
    rows = report_of(cohort.withColumn("gender", F.lit(None).cast("string")), cells)
    assert rows["completeness"]["status"] == "red" and rows["completeness"]["action"] == "refresh_clinical_table"
    assert rows["filled_age_at_index"]["value"] == 100 and rows["filled_age_at_index"]["status"] == "detail"
    ids = sorted(r[0] for r in cohort.select("sample_id").collect())
    for filled, status, action in ((0.5, "red", "impute_or_leave_out_rows"), (0.9, "yellow", "impute_gaps")):
        some = F.col("sample_id") < ids[round(filled * len(ids))]
        part = report_of(cohort.withColumn("gender", F.when(some, "male")), cells)["completeness"]
        assert (part["status"], part["action"]) == (status, action)


def test_verdict(dataset):
    cohort, cells = dataset
    report = R.readiness(R.cohort_measures(cohort), R.feature_measures(cells))
    row = R.readiness_verdict(report).first()
    assert row["verdict"] == "red"  # fewer than fifty events
    assert len(row["actions"]) == len(set(row["actions"])) > 0


# ---- many tests -----------------------------------------------------------------------

def test_q_values(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(500) ** 2, 2)  # many ties
    rows = [(i, float(v)) for i, v in enumerate(p)] + [(500, None), (501, float("nan"))]
    got = {r["i"]: r["q_value"] for r in T.benjamini_hochberg(spark.createDataFrame(rows, "i int, p_value double")).collect()}
    assert got[500] is None and got[501] is None
    assert np.allclose([got[i] for i in range(500)], reference_math.q_values(p))
    assert all(got[i] >= p[i] - 1e-12 for i in range(500))


def test_known_example(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    table = T.multiple_testing(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "name string, p_value double"))
    rows = table.collect()
    assert [r["name"] for r in rows] == ["3", "0", "2", "1", "4"]
    assert [r["q_value"] for r in rows][:4] == pytest.approx([0.02, 0.02, 0.04, 0.04])
    assert tuple(T.testing_summary(table).first()) == (4, 4, 4)


def test_rigor_report(dataset):
    parts = builds.rigor_report(*dataset, SIGNATURE_PANEL)
    assert parts["fdr_single_gene"].count() == 7 and parts["fdr_cox"].count() == 7
    assert parts["sensitivity"].count() == 6


def test_rigor_report_computes_the_matrix_once(spark, dataset):
    cohort, cells = dataset
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    parts = builds.rigor_report(cohort, cells.mapInArrow(count, cells.schema), SIGNATURE_PANEL)
    assert all(part.collect() for part in parts.values())
    assert seen.value == cells.count()

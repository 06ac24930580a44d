import pytest
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.operators import aggregates as G
from cohortmill.operators import filters as P
from cohortmill.operators import joins as J
from cohortmill.operators import quality as Q
from cohortmill.plans import builds
from tests.conftest import rows_as

CLINICAL = "case_submitter_id string, time bigint, event boolean, age_at_index bigint, gender string, ajcc_pathologic_stage string"


@pytest.fixture(scope="module")
def small(spark):
    times = [(100, True), (0, True), (-5, False), (10, False), (10, True), (None, None), (900, False)]
    clinical = spark.createDataFrame([(f"c{i}", t, e, 60, "male", "Stage I") for i, (t, e) in enumerate(times)], CLINICAL)
    sheet = spark.createDataFrame([(f"s{i}", f"c{i}", "Tumor" if i != 6 else "Normal", i != 6) for i in range(8)],
                                  "sample_id string, case_id string, tissue_type string, is_tumor boolean")
    cells = sheet.select("sample_id", F.lit("ENSG1").alias("feature_id"), F.lit(1.0).alias("value"))
    return cells, sheet, clinical


def test_dataset_filters(small):
    cells, sheet, clinical = small
    cohort, kept = builds.survival_dataset(cells, sheet, clinical, min_follow_up_days=30)
    assert cohort.columns == list(fixed.COHORT_COLUMNS)
    # an early death stays, an early censoring goes
    assert rows_as(cohort, "sample_id", "time") == [("s0", 100), ("s4", 10)]
    assert rows_as(kept, "sample_id") == [("s0",), ("s4",)]
    everyone, _ = builds.survival_dataset(cells, sheet, clinical, tumor_only=False, drop_zero_time=False)
    assert everyone.count() == 6


def test_dataset_funnel(small):
    cells, sheet, clinical = small
    steps = [tuple(r)[1:] for r in builds.build_funnel(cells.select("sample_id"), sheet, clinical, 30).orderBy("step").collect()]
    assert steps == [("all", 8, 8, 3), ("tumor", 7, 7, 3), ("time_known", 5, 5, 3), ("time_positive", 3, 3, 2),
                     ("not_short_censored", 2, 2, 2)]


def test_repeated_sheet_rows(small):
    cells, sheet, clinical = small
    twice = sheet.unionAll(sheet)
    one, _ = builds.survival_dataset(cells, twice, clinical)
    two, _ = builds.survival_dataset(cells, twice, clinical, keep_fanout=True)
    assert two.count() == 2 * one.count()


def test_dataset_errors(spark, small):
    cells, sheet, clinical = small
    with pytest.raises(ValueError, match="without a sheet row"):
        builds.survival_dataset(cells, sheet.where("sample_id <> 's0'"), clinical)
    with pytest.raises(ValueError, match="nearly empty"):
        builds.survival_dataset(cells, sheet, clinical.withColumn("gender", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="no sample is left"):
        builds.survival_dataset(cells, sheet, clinical.withColumn("time", F.lit(0).cast("bigint")))
    with pytest.raises(ValueError, match="lacks columns"):
        builds.survival_dataset(cells, sheet.drop("is_tumor"), clinical)
    wanted = spark.createDataFrame([("ENSG1",), ("ENSG9",)], "feature_id string")
    with pytest.raises(ValueError, match="ENSG9"):
        builds.survival_dataset(cells, sheet, clinical, features=wanted)


def test_completeness_levels(spark):
    df = spark.createDataFrame([(1, 1 if i < 10 else None, 1 if i < 19 else None) for i in range(20)], "a int, b int, c int")
    assert rows_as(G.completeness(df.withColumn("d", F.lit(None)), ["a", "b", "c", "d"]), "column", "level") == [
        ("a", "ok"), ("b", "warning"), ("c", "ok"), ("d", "error")]


def test_refresh_changes_only_covariates(dataset, clinical):
    cohort, _ = dataset
    broken = cohort.withColumn("gender", F.lit(None).cast("string"))
    fixed_rows = J.refresh_covariates(broken, clinical)
    assert fixed_rows.columns == cohort.columns
    assert rows_as(fixed_rows) == rows_as(cohort)
    report = {r["column"]: r for r in J.refresh_report(broken, fixed_rows, clinical).collect()}
    assert report["gender"]["pct_before"] == 0 and report["gender"]["pct_after"] == 100
    assert report["gender"]["matched"] == cohort.count()


def test_cell_comparison_pairs_rows_of_a_key(spark):
    a = spark.createDataFrame([("k", "1", "x"), ("k", "2", "'--"), ("m", "1", "y")], "key string, o string, v string")
    b = spark.createDataFrame([("k", "2", None), ("k", "1", "X"), ("m", "1", " y ")], "key string, o string, v string")
    cells = J.cell_comparison(a, b, "key", ["o", "v"], "o")
    assert rows_as(cells) == [("k", 1, "v", "x", "X")]


def test_mismatch_examples_are_few(spark):
    rows = [(f"k{i:03d}", "1", "a") for i in range(50)]
    a = spark.createDataFrame(rows, "key string, o string, v string")
    summary = J.mismatch_summary(J.cell_comparison(a, a.withColumn("v", F.lit("b")), "key", ["o", "v"], "o"), "key")
    assert rows_as(summary, "column", "n_diff", "example", "key") == [("v", 50, 1, "k000"), ("v", 50, 2, "k001"), ("v", 50, 3, "k002")]


def test_lookup_falls_back_to_the_case(spark):
    data = spark.createDataFrame([("TCGA-1-1-01A", "TCGA-1-1", 5), ("TCGA-2-2-01A", "TCGA-2-2", 7)], "sample_id string, case_id string, age int")
    samples = spark.createDataFrame([("TCGA-1-1-01A",), ("TCGA-2-2-11A",), ("TCGA-3-3-01A",)], "sample_id string")
    assert rows_as(J.clinical_lookup(samples, data, ["age"])) == [
        ("TCGA-1-1-01A", "sample", 5), ("TCGA-2-2-11A", "case", 7), ("TCGA-3-3-01A", "none", None)]


def test_quality_rules(spark):
    s = fixed.RNA_FILE_SUFFIXES[0]
    sheet = spark.createDataFrame([("f1" + s, "a", "c1"), ("f2" + s, "a", "c1"), ("f3" + s, "b", "c2")],
                                  "file_name string, sample_id string, case_id string")
    stems = spark.createDataFrame([("f1",), ("f3",), ("zz",), ("yy",)], "stem string")
    clinical = spark.createDataFrame([("c1",)], "case_submitter_id string")
    issues = Q.cohort_issues(sheet, clinical, stems)
    assert rows_as(Q.issue_counts(issues)) == [
        ("error", "missing_clinical", 1), ("error", "missing_star_file", 1),
        ("warning", "duplicate_sample", 1), ("warning", "orphan_star_file", 2)]
    assert tuple(Q.issue_summary(issues).first()) == (5, 2, 3, 0)
    assert tuple(Q.verdict(issues).first()) == (5, 4, 1, "warn")
    assert {r["category"]: r["handled"] for r in Q.triage(issues).collect()}["missing_star_file"] is False
    fine = Q.verdict(issues.where("category <> 'missing_star_file'")).first()
    assert fine["level"] == "ok" and Q.verdict(issues.where("false")).first()["level"] == "ok"
    context = issues.where("category = 'duplicate_sample'").first()["context"]
    assert context == {"sample_id": "a", "count": "2"}


def test_code_combinations(spark):
    df = spark.createDataFrame([("c1", "01B"), ("c1", "01A"), ("c2", "01A"), ("c2", "01A"), ("c3", "01A")], "case_id string, code string")
    assert rows_as(G.code_combinations(df, "code")) == [("01A x1 + 01B x1", 1), ("01A x2", 1)]


def test_profile_and_transfer(spark):
    df = spark.createDataFrame([(True, 1048576, 1.0, 1), (False, 0, 1.0, 3), (True, 0, 0.0, 0)],
                               "verified boolean, bytes_downloaded bigint, duration_s double, attempts int")
    row = G.transfer_report(df).first()
    assert (row["n_verified"], row["n_failed"], row["n_skipped"], row["all_verified"], row["mb_per_s"]) == (2, 1, 1, False, 0.5)
    assert rows_as(G.table_profile(df), "column", "n_rows", "n_null")[0] == ("attempts", 3, 0)


def test_funnel_counts_a_hot_case_once(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("case_id"),
                                  (F.col("id") % 2 == 0).alias("event"), F.col("id").alias("time"))
    rows = rows_as(P.funnel(df, {"all": F.lit(True), "late": F.col("time") >= 500}), "name", "rows", "cases", "events")
    assert rows == [("all", 1000, 101, 500), ("late", 500, 101, 250)]

"""Reports counted while writing, and joins of bucketed tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.operators import joins as J
from cohortmill.operators import observed as OB
from cohortmill.plans import builds
from cohortmill.sources import bucketed as BK
from tests.conftest import rows_as

CLINICAL = "case_submitter_id string, time bigint, event boolean, age_at_index int, gender string, ajcc_pathologic_stage string"


@pytest.fixture
def tables(spark):
    samples = spark.createDataFrame([(f"s{i}",) for i in range(60)] + [("lost",)], "sample_id string")
    sheet = spark.createDataFrame([(f"s{i}", None if i % 15 == 0 else f"c{i % 20}", "Tumor", i % 4 > 0) for i in range(60)],
                                  "sample_id string, case_id string, tissue_type string, is_tumor boolean")
    clinical = spark.createDataFrame(
        [(f"c{i}", None if i % 7 == 0 else 20 * (i % 5), None if i == 3 else i % 3 == 0, i, "male" if i % 2 else None, "Stage I")
         for i in range(18)], CLINICAL)
    return samples, sheet, clinical


def counted_runs(df, folder):
    """The rows, leaving a file for every time a task reads them."""
    def run(batches):
        (folder / uuid.uuid4().hex).write_text("")
        yield from batches

    return df.coalesce(1).mapInArrow(run, df.schema)


def test_funnel_of_the_write_equals_the_funnel(spark, tables, tmp_path):
    samples, sheet, clinical = tables
    seen = tmp_path / "seen"
    seen.mkdir()
    got = OB.write_cohort(counted_runs(samples, seen), sheet, clinical, str(tmp_path / "cohort"), 30)
    assert len(list(seen.iterdir())) == 1
    assert rows_as(got) == rows_as(builds.build_funnel(samples, sheet, clinical, 30))
    want = builds.survival_cohort(samples, sheet, clinical, min_follow_up_days=30)
    assert rows_as(spark.read.parquet(str(tmp_path / "cohort"))) == rows_as(want)
    empty = OB.write_cohort(samples.limit(0), sheet, clinical, str(tmp_path / "none"), 30)
    assert {(r["rows"], r["cases"], r["events"]) for r in empty.collect()} == {(0, 0, 0)}


def test_refresh_report_of_the_write_equals_the_report(spark, tables, tmp_path):
    samples, sheet, clinical = tables
    seen = tmp_path / "seen"
    seen.mkdir()
    stale = J.attach_sheet(samples, sheet).withColumns({
        "gender": F.lit("x"), "age_at_index": F.lit(None).cast("int"), "ajcc_pathologic_stage": F.when(F.col("is_tumor"), "Stage II")})
    got = OB.write_refreshed(counted_runs(stale, seen), clinical, str(tmp_path / "fresh"))
    assert len(list(seen.iterdir())) == 1
    fresh = J.refresh_covariates(stale, clinical)
    assert rows_as(got, "column", "pct_before", "pct_after", "n", "matched") == rows_as(
        J.refresh_report(stale, fresh, clinical), "column", "pct_before", "pct_after", "n", "matched")
    back = spark.read.parquet(str(tmp_path / "fresh"))
    assert back.columns == fresh.columns and sorted(map(str, back.collect())) == sorted(map(str, fresh.collect()))
    none = OB.write_refreshed(stale.limit(0), clinical, str(tmp_path / "none")).collect()
    assert len(none) == len(fixed.COVARIATES) and all(r["pct_after"] is None and r["n"] == 0 for r in none)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_meet_without_a_shuffle(spark, dataset):
    cohort, cells = dataset
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matrix, rows = BK.save_bucketed(cells, "sample_id", 8), BK.save_bucketed(cohort, "sample_id", 8)
        both = BK.joined(matrix, rows, "sample_id", spark=spark)
        assert "Exchange" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
        assert both.count() == cells.join(cohort, "sample_id").count()
        per_sample = BK.joined(matrix, rows, "sample_id", "left_semi", spark).groupBy("sample_id").agg(F.sum("value"))
        assert "Exchange" not in plan_of(per_sample)
        # the side that is not stored so is dealt to the buckets; the matrix stays
        mixed = plan_of(BK.joined(matrix, cohort, "sample_id"))
        assert mixed.count("Exchange hashpartitioning") == 1
        one_file = spark.table(matrix).select("sample_id", F.input_file_name().alias("f")).distinct().groupBy("sample_id").count()
        assert one_file.where("count > 1").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

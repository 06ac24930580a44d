"""Shapes of the physical plans: no pair products, no Python workers, pruned scans."""

import re

import pytest

from cohortmill.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
PLANNED = [
    "km_by_stratum", "logrank_median_split", "split_screen_all_features", "panel_screen",
    "signature_report", "fdr_q_values", "concordance_of_score", "matrix_build_deepest",
    "matrix_checks", "value_distribution", "z_scores", "feature_ranks", "build_funnel",
    "survival_dataset", "quality_issues", "cell_comparison", "clinical_lookup", "case_split",
    "scaled_training_cells", "readiness_report", "numeric_profile_by_group", "clinical_job",
    "deepest_file_per_sample", "code_combinations", "count_comparison", "marker_boxes",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                     "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert operator not in plan, operator


def test_scans_are_pruned_and_filtered(spark):
    plan = plan_of(QUERIES["km_by_stratum"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("o_totalprice" not in s and "c_name" not in s for s in schemas)
    plan = plan_of(QUERIES["missing_features"](spark, SF))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_examples_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["mismatch_summary"](spark, SF))


def test_panel_ids_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from cohortmill.operators.survival import named_features, panel_cells

    cells = spark.range(1000).select(
        F.col("id").alias("sample_id"), F.concat(F.lit("ENSG"), (F.col("id") % 50).cast("string"),
                                                 F.lit(".1")).alias("feature_id"),
        F.lit(1.0).alias("value"))
    cells.write.parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    names = named_features(stored, {"A": "ENSG7", "B": "ENSG8"})
    plan = plan_of(panel_cells(stored, names))
    assert re.search(r"PushedFilters: \[[^\]]*In\(feature_id, \[ENSG7.1,ENSG8.1\]\)", plan)


def test_small_sides_are_measured(spark):
    from cohortmill.session import broadcast_if_small

    big = spark.range(100_000).selectExpr("id as k", "id as v")
    small, large = spark.range(10).selectExpr("id as k"), spark.range(5000).selectExpr("id as k")
    assert "BroadcastHashJoin" in plan_of(big.join(broadcast_if_small(small), "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(big.join(broadcast_if_small(large, limit=1000), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

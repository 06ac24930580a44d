"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.operators import aggregates, cox, filters, joins, matrix, survival, testing
from cohortmill.operators.components import pca
from cohortmill.session import broadcast_if_small, materialize, written


def survival_cohort(samples: DataFrame, sheet: DataFrame, clinical: DataFrame,
                    tumor_only: bool = True, min_follow_up_days: int = 0,
                    drop_zero_time: bool = True, keep_fanout: bool = False) -> DataFrame:
    """Samples joined to their sheet row and clinical row, with the survival filters applied."""
    filters.require_columns(sheet, ("sample_id", "case_id", "tissue_type", "is_tumor"), "sheet")
    filters.require_columns(
        clinical, ("case_submitter_id", "time", "event", *fixed.COVARIATES), "clinical")
    rows = joins.attach_sheet(samples.select("sample_id"), sheet, keep_fanout=keep_fanout)
    if tumor_only:
        rows = rows.where("is_tumor")
    rows = joins.attach_clinical(rows.drop("is_tumor"), clinical)
    kept = filters.follow_up_filter(rows, min_follow_up_days, drop_zero_time)
    return kept.select(*fixed.COHORT_COLUMNS)


def survival_dataset(expression: DataFrame, sheet: DataFrame, clinical: DataFrame,
                     features: DataFrame | None = None, check: bool = True,
                     **options) -> tuple[DataFrame, DataFrame]:
    """(cohort, cells of its samples).

    The filters run on the cohort, which has a handful of columns; the matrix is touched last,
    by a semi join. ``check`` raises on samples without a sheet row, an empty result or an
    empty covariate.
    """
    samples = materialize(expression.select("sample_id").distinct())
    cohort = materialize(survival_cohort(samples, sheet, clinical, **options))
    cells = expression
    if features is not None:
        cells = filters.feature_subset(cells, features)
    if check:
        lost = samples.join(sheet.select("sample_id"), "sample_id", "left_anti").limit(3).collect()
        if lost:
            raise ValueError(f"samples without a sheet row: {[r[0] for r in lost]}")
        problems = [r for r in aggregates.completeness(cohort).collect()]
        if problems[0]["n"] == 0:
            raise ValueError("no sample is left after the filters")
        empty = [r["column"] for r in problems if r["level"] == "error"]
        if empty:
            raise ValueError(f"covariates are nearly empty: {empty}; rebuild the clinical table")
    kept = broadcast_if_small(cohort.select("sample_id").distinct())
    return cohort, cells.join(kept, "sample_id", "left_semi")


def build_funnel(samples: DataFrame, sheet: DataFrame, clinical: DataFrame,
                 min_follow_up_days: int = 30) -> DataFrame:
    """Rows, cases and events after each filter of the dataset build."""
    rows = joins.attach_clinical(joins.attach_sheet(samples, sheet), clinical)
    steps = filters.follow_up_steps(min_follow_up_days, tumor="is_tumor")
    return filters.funnel(rows, steps)


def matrix_summary(expression: DataFrame, markers=fixed.MARKER_GENES, top_n: int = 2000,
                   components: int = 5) -> dict[str, DataFrame]:
    """The matrix report as small tables: size, values, sites, components, markers."""
    variance, _ = pca(expression, components, top_n)
    size = expression.agg(
        F.count_distinct("feature_id").alias("n_features"),
        F.count_distinct("sample_id").alias("n_samples"),
    ).withColumn("biotype_filtered", F.col("n_features") < fixed.FEATURE_TOTAL)
    return {
        "size": size,
        "distribution": matrix.value_distribution(expression),
        "sites": matrix.site_distribution(expression.withColumn(
            "sample_id", F.col("sample_id").cast("string"))),
        "components": variance,
        "markers": matrix.marker_summary(expression, markers),
    }


def panel_testing(cohort: DataFrame, expression: DataFrame, panel, source: str = "single_gene",
                  alpha: float = fixed.ALPHA) -> DataFrame:
    """q-values over the panel, from one-feature log-rank tests or from the panel Cox model."""
    if source == "cox":
        effects, _, _ = cox.panel_report(cohort, expression, panel)
        tests = effects.select(F.col("covariate").alias("name"), "p_value")
    else:
        bases = {s: base for s, (base, _) in panel.items()}
        tests = survival.panel_screen(expression, cohort, bases).select(
            F.col("symbol").alias("name"), "p_value")
    return testing.multiple_testing(tests, "p_value", alpha).withColumn("source", F.lit(source))


def rigor_report(cohort: DataFrame, expression: DataFrame, panel,
                 alpha: float = fixed.ALPHA) -> dict[str, DataFrame]:
    """The cohort and the panel's cells are computed once for all parts."""
    cohort = materialize(cohort)
    expression = written(expression.where(survival.named("feature_id", [base for base, _ in panel.values()])))
    return {
        "fdr_single_gene": panel_testing(cohort, expression, panel, "single_gene", alpha),
        "fdr_cox": panel_testing(cohort, expression, panel, "cox", alpha),
        "sensitivity": survival.sensitivity(cohort, alpha=alpha),
    }

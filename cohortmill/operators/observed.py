"""Reports that are counted while a result is written, in the same pass over the data.

Observed metrics ride along with the write: what the funnel and the refresh report need is added up
by the tasks that write the rows, so no input is read a second time. The counts of a write whose
tasks were run again after a lost executor may include their rows twice; write again, or count the
written table, where that matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.operators import joins
from cohortmill.operators.filters import follow_up_steps


def write_through_funnel(rows: DataFrame, steps: Mapping[str, Column], path: str, columns: Sequence[str],
                         case: str = "case_id", row: str = "sample_id", event: str = "event") -> DataFrame:
    """Writes the rows that pass all steps, and gives ``filters.funnel`` of the same pass.

    How many steps in a row each row passes is one number; a case is left after a step if its best row
    is. Rows without a case count as one case; they are told apart by ``row``, so that they do not
    meet in one task.
    """
    passed, depth = F.lit(True), F.lit(0)
    for condition in steps.values():
        passed = passed & F.coalesce(condition, F.lit(False))
        depth = depth + passed.cast("int")
    key = F.struct(F.col(case), F.when(F.col(case).isNull(), F.col(row)))
    marked = rows.withColumn("__depth", depth).withColumn("__key", key)
    of_case = Window.partitionBy("__key")
    marked = marked.withColumns({
        "__best": F.max("__depth").over(of_case),
        "__first": (F.row_number().over(of_case.orderBy(F.col("__depth").desc(), row)) == 1) & F.col(case).isNotNull()})
    seen = Observation()
    metrics = [m for i in range(1, len(steps) + 1) for m in (
        F.count_if(F.col("__depth") >= i).alias(f"r{i}"),
        F.count_if(F.col("__first") & (F.col("__best") >= i)).alias(f"c{i}"),
        F.count_if(F.col(case).isNull() & (F.col("__depth") >= i)).alias(f"u{i}"),
        F.count_if((F.col("__depth") >= i) & F.col(event)).alias(f"e{i}"))]
    marked.observe(seen, *metrics).where(F.col("__depth") == len(steps)).select(*columns).write.mode("overwrite").parquet(path)
    counts = seen.get
    return rows.sparkSession.createDataFrame(
        [(i, name, counts[f"r{i + 1}"], counts[f"c{i + 1}"] + (counts[f"u{i + 1}"] > 0), counts[f"e{i + 1}"]) for i, name in enumerate(steps)],
        "step int, name string, rows bigint, cases bigint, events bigint")


def write_cohort(samples: DataFrame, sheet: DataFrame, clinical: DataFrame, path: str, min_follow_up_days: int = 30) -> DataFrame:
    """Writes the survival cohort of the samples and gives the funnel of its build."""
    rows = joins.attach_clinical(joins.attach_sheet(samples, sheet), clinical)
    return write_through_funnel(rows, follow_up_steps(min_follow_up_days, tumor="is_tumor"), path, fixed.COHORT_COLUMNS)


def write_refreshed(dataset: DataFrame, clinical: DataFrame, path: str, columns: Sequence[str] = fixed.COVARIATES,
                    case: str = "case_id", clinical_case: str = "case_submitter_id") -> DataFrame:
    """Writes the dataset with its covariates taken anew and gives ``joins.refresh_report`` of the same
    pass; ``clinical`` has one row per case. Percentages of no rows are null."""
    present = [c for c in columns if c in clinical.columns]
    side = clinical.select(F.col(clinical_case).alias(case), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in present])
    old = [c for c in columns if c in dataset.columns]
    joined = dataset.join(side, case, "left")
    seen = Observation()
    metrics = [F.count("*").alias("n"), F.count("__hit").alias("matched"),
               *[F.count(c).alias(f"old_{c}") for c in old], *[F.count(f"__new_{c}").alias(f"new_{c}") for c in present]]
    kept = [F.col(f"__new_{c}").alias(c) if c in present else F.col(c) for c in dataset.columns if c in present or c not in columns]
    joined.observe(seen, *metrics).select(*kept).write.mode("overwrite").parquet(path)
    counts = seen.get
    n = counts["n"]

    def share(count: int) -> float | None:
        return 100.0 * count / n if n else None

    return dataset.sparkSession.createDataFrame(
        [(c, share(counts[f"old_{c}"]), share(counts[f"new_{c}"]), n, counts["matched"]) for c in columns if c in old and c in present],
        "column string, pct_before double, pct_after double, n bigint, matched bigint")

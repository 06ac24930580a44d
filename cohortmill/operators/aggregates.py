"""Counts, shares, profiles and completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.functions.numbers import percent, ratio
from cohortmill.operators.ranges import quantiles


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *columns)


def unique_count(df: DataFrame, column: str) -> DataFrame:
    """Rows and distinct values; n_rows = n_unique means no duplicates."""
    return df.groupBy(column).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n_rows"), F.count(column).alias("n_unique")
    )


def sample_depth(expression: DataFrame, sample: str = "sample_id",
                 value: str = "value") -> DataFrame:
    return expression.groupBy(sample).agg(F.sum(value).alias("depth"))


def depth_ratio(depths: DataFrame, first, second, sample: str = "sample_id") -> DataFrame:
    """Depth of two samples and their ratio, as one row."""
    two = depths.where(F.col(sample).isin(first, second)).agg(
        F.max(F.when(F.col(sample) == first, F.col("depth"))).alias("depth_first"),
        F.max(F.when(F.col(sample) == second, F.col("depth"))).alias("depth_second"),
    )
    return two.withColumn("depth_ratio", ratio(F.col("depth_first"), F.col("depth_second")))


def numeric_profile(df: DataFrame, column: str, keys: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """n, min, quartiles (interpolated, or of the nearest rank), mean, max and coefficient of
    variation (population sd), exact."""
    x = F.col(column)
    moments = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.min(x).cast("double").alias("min"),
        F.avg(x).alias("mean"), F.max(x).cast("double").alias("max"),
        (F.lit(100.0) * ratio(F.stddev_pop(x), F.avg(x))).alias("cv_pct"),
    )
    points = quantiles(df, keys, column, {"q25": 0.25, "median": 0.5, "q75": 0.75}, nearest=nearest)
    if keys:
        return moments.join(points, list(keys))
    return moments.withColumn("__q", points.select(F.struct("*")).scalar()).select(
        "*", "__q.*").drop("__q")


def event_rates(cohort: DataFrame, group: str, event: str = "event") -> DataFrame:
    events = F.coalesce(F.sum(F.col(event).cast("int")), F.lit(0))
    return cohort.groupBy(group).agg(
        F.count("*").alias("n_samples"), events.alias("n_events"),
        F.round(percent(events, F.count("*")), 1).alias("event_rate_pct"),
    )


def multi_sample_cases(samples: DataFrame, case: str = "case_id",
                       sample: str = "sample_id") -> DataFrame:
    """Every sample of the cases that have several, with the number of samples of the case.

    One row per sample rather than a list per case, so a case of any size fits.
    """
    several = samples.groupBy(case).agg(F.count("*").alias("n_samples")).where("n_samples > 1")
    return samples.select(case, sample).join(several, case)


def excess_samples(samples: DataFrame, case: str = "case_id") -> DataFrame:
    several = samples.groupBy(case).agg(F.count("*").alias("n")).where("n > 1")
    return several.agg(
        F.count("*").alias("n_cases"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_excess"),
    )


def code_combinations(samples: DataFrame, code: str, case: str = "case_id") -> DataFrame:
    """How many multi-sample cases show each combination of sample codes.

    Codes are counted per case first; a combination names each code once with its count, as
    "01A x2 + 02A x1", so its length does not depend on how often a case repeats a code.
    """
    per_code = samples.groupBy(case, code).agg(F.count("*").alias("n"))
    per_case = per_code.groupBy(case).agg(
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col(code).alias("code"), "n"))).alias("codes"),
    ).where("n > 1")
    written = F.transform(
        F.filter("codes", lambda c: c["code"].isNotNull()),
        lambda c: F.concat(c["code"], F.lit(" x"), c["n"].cast("string")))
    return per_case.select(F.array_join(written, " + ").alias("combination")).groupBy(
        "combination").agg(F.count("*").alias("n_cases")).orderBy(F.col("n_cases").desc(),
                                                                  "combination")


def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").orderBy(*columns)


def completeness(df: DataFrame, columns: Sequence[str] = fixed.COVARIATES,
                 error_below: float = fixed.COMPLETENESS_ERROR_BELOW,
                 warning_below: float = fixed.COMPLETENESS_WARNING_BELOW) -> DataFrame:
    """Filled share per column with a level: error, warning or ok."""
    filled = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    rows = filled.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("n").alias("n"))
        for c in columns
    ])))
    share = ratio(F.col("filled"), F.col("n"))
    return rows.withColumn("pct", F.lit(100.0) * share).withColumn(
        "level",
        F.when(share < error_below, "error").when(share < warning_below, "warning")
        .otherwise("ok"),
    )


def cohort_summary(cohort: DataFrame, n_features: int | Column | None = None, time: str = "time",
                   event: str = "event") -> DataFrame:
    """One row: samples, events, censoring and median follow-up.

    The median comes from the counts per day, which stay few. ``n_features`` is a number or a
    column, such as a scalar subquery that counts them.
    """
    day = cohort.groupBy(time).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("int")).alias("d")
    )
    row = day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("n_events"),
        F.percentile(F.col(time).cast("double"), F.lit(0.5), F.col("n")).alias("median_days"),
    )
    out = row.select(
        "n_samples", "n_events", (F.col("n_samples") - F.col("n_events")).alias("n_censored"),
        F.coalesce(percent(F.col("n_samples") - F.col("n_events"), F.col("n_samples")),
                   F.lit(0.0)).alias("censoring_pct"),
        (F.coalesce("median_days", F.lit(0.0)) / fixed.DAYS_PER_YEAR)
        .alias("median_followup_years"),
    )
    if n_features is not None:
        out = out.withColumn("n_features", F.lit(n_features).cast("bigint"))
    return out


def composition_change(before: DataFrame, kept: DataFrame, group: str = "tissue_type",
                       sample: str = "sample_id") -> DataFrame:
    """Rows per group before and after keeping only the samples in ``kept``."""
    marks = kept.select(F.col(sample).alias("__kept")).distinct()
    rows = before.join(marks, F.col(sample) == F.col("__kept"), "left")
    return rows.groupBy(group).agg(
        F.count("*").alias("n_before"), F.count("__kept").alias("n_after"),
        (F.count("*") - F.count("__kept")).alias("n_removed"),
    )


def group_shares(df: DataFrame, group: str) -> DataFrame:
    """Rows and percentage per group, largest first, with flags for large and tiny groups."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        group, "n", percent(F.col("n"), total).alias("pct"),
        (F.col("n") >= 10).alias("at_least_10"), (F.col("n") <= 2).alias("at_most_2"),
    ).orderBy(F.col("n").desc(), group)


def first_per_group(df: DataFrame, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per group."""
    return df.groupBy(group).agg(
        F.min_by(F.struct(order, *columns), F.col(order)).alias("__row")
    ).select(group, "__row.*")


def transfer_report(transfers: DataFrame, verified: str = "verified",
                    size: str = "bytes_downloaded", seconds: str = "duration_s",
                    attempts: str = "attempts") -> DataFrame:
    """Verified, failed and skipped files, volume and speed."""
    ok = F.col(verified)
    totals = transfers.agg(
        F.count("*").alias("n_files"), F.count_if(ok).alias("n_verified"),
        F.count_if(~ok).alias("n_failed"),
        F.count_if(F.col(attempts) == 0).alias("n_skipped"),
        F.sum(size).alias("total_bytes"), F.sum(seconds).alias("total_seconds"),
        F.bool_and(ok).alias("all_verified"),
    )
    mb = F.col("total_bytes") / F.lit(1024.0 * 1024.0)
    return totals.withColumn("total_mb", mb).withColumn(
        "mb_per_s", F.when(F.col("total_seconds") > 0, ratio(mb, F.col("total_seconds")))
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and, per column, type and nulls, from one scan."""
    counts = df.agg(F.count("*").alias("__n"), *[
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(df.columns)
    ])
    types: Mapping[str, str] = dict(df.dtypes)
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.lit(types[c]).alias("type"), F.col("__n").alias("n_rows"),
                 F.lit(len(df.columns)).alias("n_columns"), F.col(f"__{i}").alias("n_null"))
        for i, c in enumerate(df.columns)
    ])))

"""Kaplan-Meier, log-rank, median splits and study sensitivity.

Times are whole days, so (group, time) tables hold at most a few ten thousand rows per
group whatever the cohort size. Every window below runs on such a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cohortmill.functions import fixed
from cohortmill.functions.clinical import years
from cohortmill.functions.identifiers import base_feature
from cohortmill.functions.numbers import log2p1, ratio
from cohortmill.functions.probability import chi2_sf, normal_cdf, normal_quantile
from cohortmill.operators.ranges import quantiles
from cohortmill.session import broadcast_if_small, materialize, written

Z95 = normal_quantile(0.975)


def _deaths(event: str) -> Column:
    return F.col(event).cast("boolean").cast("bigint")


def require_days(rows: DataFrame, time: str) -> None:
    """Times must be of a whole-number type: tables per day stay small only then."""
    kind = rows.schema[time].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{time} must hold whole days, not {kind.simpleString()}")


def time_table(cohort: DataFrame, strata: Sequence[str] = (), time: str = "time",
               event: str = "event") -> DataFrame:
    """Deaths and leavers per stratum and day."""
    require_days(cohort, time)
    return cohort.where(F.col(time).isNotNull()).groupBy(*strata, time).agg(
        F.coalesce(F.sum(_deaths(event)), F.lit(0)).alias("deaths"),
        F.count("*").alias("leaving"),
    )


def km_curve(cohort: DataFrame, strata: Sequence[str] = (), time: str = "time",
             event: str = "event", origin: bool = False) -> DataFrame:
    """Kaplan-Meier estimate with a 95 % log-log confidence band.

    One row per stratum and day: at_risk, deaths, survival, ci_lower, ci_upper.
    ``origin`` adds the point at day zero where everyone is alive.
    """
    strata = list(strata)
    table = time_table(cohort, strata, time, event)
    if origin:
        zero = F.lit(0).cast("bigint")
        start = table.groupBy(*strata).agg(F.min(zero).alias("deaths")).select(
            *strata, zero.cast(table.schema[time].dataType).alias(time), "deaths",
            zero.alias("leaving"),
        )
        table = table.unionByName(start).groupBy(*strata, time).agg(
            F.sum("deaths").alias("deaths"), F.sum("leaving").alias("leaving")
        )
    return _km_from_table(table, strata, time)


def _km_from_table(table: DataFrame, strata: Sequence[str], time: str) -> DataFrame:
    back = Window.partitionBy(*strata).orderBy(F.col(time).desc())
    forth = Window.partitionBy(*strata).orderBy(time)
    d, n = F.col("deaths"), F.col("at_risk")
    left = (n - d).cast("double")
    log_s = F.ln(F.col("survival"))
    spread = F.lit(Z95) * F.sqrt("greenwood") / log_s

    def bound(sign: int) -> Column:
        return (
            F.when(F.col("survival") <= 0.0, F.lit(0.0))
            .when(F.col("survival") >= 1.0, F.lit(1.0))
            .otherwise(F.pow(F.col("survival"), F.exp(F.lit(float(sign)) * spread)))
        )

    return (
        table
        .withColumn("at_risk", F.sum("leaving").over(back))
        .withColumn("survival", F.product(F.lit(1.0) - d / n).over(forth))
        .withColumn("greenwood", F.sum(
            F.when(left > 0, d / (n * left)).otherwise(F.lit(0.0))
        ).over(forth))
        .withColumn("ci_lower", bound(-1))
        .withColumn("ci_upper", bound(1))
        .select(*strata, time, "at_risk", "deaths", "survival", "greenwood",
                "ci_lower", "ci_upper")
    )


def km_statistics(curve: DataFrame, strata: Sequence[str] = (), time: str = "time",
                  at_years: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """n, median survival (null when not reached) and survival at whole years."""
    aggs = [
        F.max("at_risk").alias("n"),
        F.sum("deaths").alias("n_events"),
        F.min(F.when(F.col("survival") <= 0.5, F.col(time))).alias("median_days"),
    ]
    for y in at_years:
        due = F.col(time) <= F.lit(y * fixed.DAYS_PER_YEAR)
        step = F.max_by(F.when(due, F.col("survival")), F.when(due, F.col(time)))
        aggs.append(F.coalesce(step, F.lit(1.0)).alias(f"surv_{y}y"))
    stats = curve.groupBy(*strata).agg(*aggs)
    return stats.withColumn("median_os_years", years(F.col("median_days")))


def known_strata(cohort: DataFrame, stratum: str, levels: Sequence[str],
                 min_rows: int = 2) -> DataFrame:
    """Rows of the listed strata that hold at least ``min_rows`` rows."""
    inside = cohort.where(F.col(stratum).isin(*levels))
    large = inside.groupBy(stratum).count().where(F.col("count") >= min_rows)
    return inside.join(large.select(stratum), stratum, "left_semi")


def km_by_stratum(cohort: DataFrame, stratum: str = "stage_group",
                  levels: Sequence[str] = fixed.MAIN_STAGES, time: str = "time",
                  event: str = "event", min_rows: int = 2) -> DataFrame:
    """Overall curve (``stratum`` = "overall") and one curve per listed stratum.

    The overall day table is the sum of the day table per stratum, so the cohort is read once.
    """
    table = time_table(cohort, [stratum], time, event)
    sizes = Window.partitionBy(stratum)
    kept = (
        table.where(F.col(stratum).isin(*levels))
        .withColumn("__n", F.sum("leaving").over(sizes))
        .where(F.col("__n") >= min_rows).drop("__n")
    )
    overall = table.groupBy(time).agg(
        F.sum("deaths").alias("deaths"), F.sum("leaving").alias("leaving")
    ).withColumn(stratum, F.lit("overall"))
    return _km_from_table(overall.unionByName(kept), [stratum], time)


# ---- log-rank ---------------------------------------------------------------------

def split_table(rows: DataFrame, high: str = "high", keys: Sequence[str] = (),
                time: str = "time", event: str = "event") -> DataFrame:
    """Per key and day: leavers (c1, c0) and deaths (d1, d0) of the high and the low group."""
    require_days(rows, time)
    side, died = F.col(high).cast("bigint"), _deaths(event)
    return rows.groupBy(*keys, time).agg(
        F.sum(side).alias("c1"), F.sum(1 - side).alias("c0"),
        F.sum(side * died).alias("d1"), F.sum((1 - side) * died).alias("d0"),
    )


def logrank_from_table(table: DataFrame, keys: Sequence[str] = (),
                       time: str = "time") -> DataFrame:
    """Log-rank test and high-group median survival per key, in one pass over the day table."""
    back = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    forth = Window.partitionBy(*keys).orderBy(time)
    n = (F.col("n1") + F.col("n0")).cast("double")
    d = (F.col("d1") + F.col("d0")).cast("double")
    days = (
        table
        .withColumns({"n1": F.sum("c1").over(back), "n0": F.sum("c0").over(back)})
        .withColumn("s1", F.product(
            F.lit(1.0) - F.coalesce(F.col("d1") / F.nullif(F.col("n1"), F.lit(0)), F.lit(0.0))
        ).over(forth))
    )
    spread = F.col("n1") * F.col("n0") * d * (n - d) / F.nullif(n * n * (n - 1), F.lit(0.0))
    tests = days.groupBy(*keys).agg(
        F.sum("c1").alias("n_high"), F.sum("c0").alias("n_low"),
        F.sum("d1").alias("events_high"), F.sum("d0").alias("events_low"),
        F.sum(F.when(d > 0, F.col("n1") * d / n)).alias("expected_high"),
        F.sum(F.when(d > 0, F.coalesce(spread, F.lit(0.0)))).alias("variance"),
        F.min(F.when((F.col("s1") <= 0.5) & (F.col("n1") > 0), F.col(time)))
        .alias("median_days_high"),
    )
    gap = F.col("events_high") - F.col("expected_high")
    both = (F.col("n_high") > 0) & (F.col("n_low") > 0)
    return tests.withColumn(
        "chi2", F.when(both, ratio(gap * gap, F.col("variance")))
    ).withColumn("p_value", chi2_sf(F.col("chi2"), 1))


def logrank_two_groups(rows: DataFrame, high: str = "high", keys: Sequence[str] = (),
                       time: str = "time", event: str = "event") -> DataFrame:
    """Two-sample log-rank test of ``high`` against the rest, one test per key.

    All keys (features) are tested in the same job.
    """
    return logrank_from_table(split_table(rows, high, keys, time, event), keys, time).drop(
        "median_days_high")


def logrank_moments(rows: DataFrame, stratum: str, levels: Sequence[str],
                    time: str = "time", event: str = "event") -> DataFrame:
    """One row: observed, expected and covariance entries for k known strata."""
    require_days(rows, time)
    day = rows.where(F.col(stratum).isin(*levels)).groupBy(time).agg(*[
        agg
        for i, level in enumerate(levels)
        for agg in (
            F.count_if(F.col(stratum) == level).alias(f"c{i}"),
            F.count_if((F.col(stratum) == level) & F.col(event)).alias(f"d{i}"),
        )
    ])
    back = Window.orderBy(F.col(time).desc())  # one row per day
    k = range(len(levels))
    day = day.withColumns({f"n{i}": F.sum(f"c{i}").over(back) for i in k})
    n = sum((F.col(f"n{i}") for i in k), F.lit(0.0))
    d = sum((F.col(f"d{i}") for i in k), F.lit(0.0))
    day = day.withColumns({"n": n, "d": d}).where(F.col("d") > 0)
    n, d = F.col("n"), F.col("d")
    scale = d * F.coalesce((n - d) / F.nullif(n - 1, F.lit(0.0)), F.lit(1.0))
    aggs = []
    for i in k:
        share = F.col(f"n{i}") / n
        aggs.append(F.sum(f"d{i}").cast("double").alias(f"o{i}"))
        aggs.append(F.sum(share * d).alias(f"e{i}"))
        for j in range(i, len(levels)):
            diagonal = F.lit(1.0 if i == j else 0.0)
            aggs.append(F.sum(
                scale * share * (diagonal - F.col(f"n{j}") / n)
            ).alias(f"v{i}{j}"))
    return day.agg(*aggs)


def logrank_strata(rows: DataFrame, stratum: str = "stage_group",
                   levels: Sequence[str] = fixed.MAIN_STAGES, time: str = "time",
                   event: str = "event", min_known: int = 10) -> DataFrame:
    """k-sample log-rank test: chi2, degrees of freedom, p (null when too few rows).

    Only the k x k moments (k a handful of listed strata) come to the driver.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(stratum).isin(*levels)).groupBy(stratum).count().collect()
    present = [level for level in levels if level in {r[0] for r in known}]
    n_known = sum(r[1] for r in known)
    chi2 = None
    if n_known > min_known and len(present) > 1:
        m = logrank_moments(rows, stratum, present, time, event).first()
        if m["o0"] is not None:
            k = len(present)
            gap = np.array([m[f"o{i}"] - m[f"e{i}"] for i in range(k)])[:-1]
            cov = np.array([[m[f"v{min(i, j)}{max(i, j)}"] for j in range(k)]
                            for i in range(k)])[:-1, :-1]
            chi2 = float(gap @ np.linalg.pinv(cov) @ gap)
    result = spark.createDataFrame(
        [(n_known, len(present), chi2)], "n_known bigint, n_strata int, chi2 double"
    )
    return result.withColumn("p_value", chi2_sf(F.col("chi2"), len(present) - 1))


# ---- median splits ----------------------------------------------------------------

def median_split(scores: DataFrame, keys: Sequence[str] = (), value: str = "value",
                 out: str = "high") -> DataFrame:
    """Marks rows at or above the exact median of their group."""
    keys = list(keys)
    medians = quantiles(scores, keys, value, {"median_split": 0.5})
    if keys:
        joined = scores.join(medians, keys)
    else:
        joined = scores.withColumn("median_split", medians.scalar())
    return joined.withColumn(out, F.col(value) >= F.col("median_split"))


def survival_cells(expression: DataFrame, cohort: DataFrame, feature: str = "feature_id",
                   value: str = "value", sample: str = "sample_id", time: str = "time",
                   event: str = "event") -> DataFrame:
    """Cells of the cohort's samples with time and event, stored feature by feature.

    Screening reads this table several times, a few columns each time, and counts per feature
    shrink inside the tasks that read it.
    """
    times = broadcast_if_small(cohort.select(sample, time, event))
    joined = expression.select(sample, feature, value).join(times, sample)
    return written(joined, feature)


def split_screen(expression: DataFrame, cohort: DataFrame | None = None,
                 feature: str = "feature_id", value: str = "value", sample: str = "sample_id",
                 time: str = "time", event: str = "event") -> DataFrame:
    """Median split, log-rank test and high-group median survival for every feature at once.

    Without ``cohort`` the expression already carries time and event (``survival_cells``).
    """
    rows = expression if cohort is None else survival_cells(
        expression, cohort, feature, value, sample, time, event)
    medians = broadcast_if_small(quantiles(rows, [feature], value, {"median_split": 0.5}))
    marked = rows.join(medians, feature).withColumn(
        "high", F.col(value) >= F.col("median_split"))
    tests = logrank_from_table(split_table(marked, "high", [feature], time, event),
                               [feature], time)
    return tests.join(medians, feature).withColumn(
        "median_os_high", years(F.col("median_days_high")))


def split_report(rows: DataFrame, value: str = "score", time: str = "time",
                 event: str = "event") -> DataFrame:
    """One score per row: statistics of the high and low groups with the log-rank test."""
    median = quantiles(rows, (), value, {"median_split": 0.5}).first()[0]  # one number
    marked = rows.withColumn("high", F.col(value) >= F.lit(median))
    table = split_table(marked, "high", (), time, event)
    sides = table.select(time, F.inline(F.array(
        F.struct(F.lit(True).alias("high"), F.col("d1").alias("deaths"),
                 F.col("c1").alias("leaving")),
        F.struct(F.lit(False).alias("high"), F.col("d0").alias("deaths"),
                 F.col("c0").alias("leaving")),
    ))).where("leaving > 0")
    stats = km_statistics(_km_from_table(sides, ["high"], time), ["high"], time)
    test = logrank_from_table(table, (), time).select(F.struct("chi2", "p_value")).scalar()
    return stats.withColumns({"median_split": F.lit(median), "__test": test}).select(
        "*", "__test.*").drop("__test")


def named(feature: str, bases: Iterable[str]) -> Column:
    """Whether a feature id is one of ``bases``, versioned or not."""
    bases = list(bases)
    match = F.col(feature).isin(*bases)
    for base in bases:
        match = match | F.col(feature).startswith(base + ".")
    return match


def named_features(expression: DataFrame, panel: Mapping[str, str],
                   feature: str = "feature_id", ordinal: str | None = None) -> DataFrame:
    """Symbols with the matching feature id, versioned or not; null when absent.

    Of several versions the first one (by ``ordinal``, else by id) is taken. The conditions on
    the id reach the parquet scan.
    """
    spark = expression.sparkSession
    names = spark.createDataFrame(list(panel.items()), "symbol string, base string")
    ids = expression.where(named(feature, panel.values())).groupBy(feature).agg(F.min(ordinal or feature).alias("__order"))
    first = ids.groupBy(base_feature(F.col(feature)).alias("base")).agg(
        F.min_by(feature, F.struct("__order", feature)).alias(feature)
    )
    return materialize(names.join(first, "base", "left"))


def panel_cells(expression: DataFrame, names: DataFrame, feature: str = "feature_id") -> DataFrame:
    """Cells of the named features with their symbol; the ids are a filter on the scan."""
    found = names.where(F.col(feature).isNotNull()).select("symbol", feature)
    ids = [r[feature] for r in found.collect()]  # as many as the panel has symbols
    return expression.where(F.col(feature).isin(*ids)).join(F.broadcast(found), feature)


def panel_screen(expression: DataFrame, cohort: DataFrame, panel: Mapping[str, str],
                 feature: str = "feature_id", **columns) -> DataFrame:
    """split_screen for named features; a missing one keeps its row with a note."""
    names = named_features(expression, panel, feature)
    chosen = panel_cells(expression, names.dropDuplicates([feature]), feature).drop("symbol")
    tests = split_screen(chosen, cohort, feature, **columns)
    return names.join(tests, feature, "left").withColumn(
        "note", F.when(F.col(feature).isNull(), "not in the matrix").otherwise("")
    )


def feature_split_report(expression: DataFrame, cohort: DataFrame, symbol: str, base: str,
                         feature: str = "feature_id", sample: str = "sample_id") -> DataFrame:
    """Median split on one named feature."""
    names = named_features(expression, {symbol: base}, feature)
    values = panel_cells(expression, names, feature)
    rows = materialize(values.join(cohort.select(sample, "time", "event"), sample))
    return split_report(rows, "value").withColumn("symbol", F.lit(symbol))


def signature_score(expression: DataFrame, panel: Mapping[str, tuple[str, int]],
                    feature: str = "feature_id", value: str = "value",
                    sample: str = "sample_id") -> DataFrame:
    """Signed sum of z-scored log2 values per sample; constant features do not count."""
    scaled = panel_z_scores(expression, panel, feature, value, sample)
    return scaled.groupBy(sample).agg(
        F.sum(F.col("sign") * F.col("z")).alias("score"),
        F.count("*").cast("int").alias("n_features"),
    )


def panel_z_scores(expression: DataFrame, panel: Mapping[str, tuple[str, int]],
                   feature: str = "feature_id", value: str = "value",
                   sample: str = "sample_id") -> DataFrame:
    """Long z-scores of log2(x+1) for the panel features that vary."""
    spark = expression.sparkSession
    names = named_features(expression, {s: base for s, (base, _) in panel.items()}, feature)
    signs = spark.createDataFrame(
        [(s, sign) for s, (_, sign) in panel.items()], "symbol string, sign int"
    )
    rows = panel_cells(expression, names, feature).join(F.broadcast(signs), "symbol").withColumn(
        "x", log2p1(F.col(value)))
    stats = rows.groupBy(feature).agg(
        F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")
    ).where(F.col("sd") > 0)
    return rows.join(F.broadcast(stats), feature).select(  # one row per panel feature
        sample, "symbol", "sign", feature, ((F.col("x") - F.col("mu")) / F.col("sd")).alias("z")
    )


def signature_report(expression: DataFrame, cohort: DataFrame,
                     panel: Mapping[str, tuple[str, int]], sample: str = "sample_id",
                     **columns) -> DataFrame:
    scores = materialize(signature_score(expression, panel, sample=sample, **columns))
    rows = materialize(scores.join(cohort.select(sample, "time", "event"), sample))
    found = scores.agg(F.max("n_features"))
    return split_report(rows, "score").withColumn("n_features", F.lit(found.first()[0]))


# ---- sensitivity ------------------------------------------------------------------

def minimal_hazard_ratio(events: Column, power: float, alpha: float = fixed.ALPHA,
                         allocation: float = 0.5) -> Column:
    """Smallest hazard ratio a study with this many events can detect (Schoenfeld)."""
    reach = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    spread = F.sqrt(events * F.lit(allocation * (1 - allocation)))
    return F.when(events > 0, F.exp(F.lit(reach) / F.nullif(spread, F.lit(0.0)))).otherwise(
        F.lit(float("inf"))
    )


def power_at(events: Column, hazard_ratio: float, alpha: float = fixed.ALPHA,
             allocation: float = 0.5) -> Column:
    """Power to detect this hazard ratio."""
    if hazard_ratio <= 0:
        return F.lit(0.0)
    spread = F.sqrt(events * F.lit(allocation * (1 - allocation)))
    z = spread * F.abs(F.ln(F.lit(hazard_ratio))) - F.lit(normal_quantile(1 - alpha / 2))
    return F.when(events > 0, normal_cdf(z)).otherwise(F.lit(0.0))


def sensitivity(cohort: DataFrame, keys: Sequence[str] = (), event: str = "event",
                alpha: float = fixed.ALPHA, allocation: float = 0.5,
                powers: Sequence[float] = (0.80, 0.90),
                hazard_ratios: Sequence[float] = (1.3, 1.5, 1.75, 2.0)) -> DataFrame:
    """Minimal detectable hazard ratio per power and power per hazard ratio, per group."""
    events = cohort.groupBy(*keys).agg(F.sum(_deaths(event)).alias("n_events"))
    cells = [
        F.struct(F.lit("min_hr").alias("measure"), F.lit(float(p)).alias("level"),
                 minimal_hazard_ratio(F.col("n_events"), p, alpha, allocation).alias("result"))
        for p in powers
    ] + [
        F.struct(F.lit("power").alias("measure"), F.lit(float(h)).alias("level"),
                 power_at(F.col("n_events"), h, alpha, allocation).alias("result"))
        for h in hazard_ratios
    ]
    return events.select(*keys, "n_events", F.inline(F.array(*cells)))

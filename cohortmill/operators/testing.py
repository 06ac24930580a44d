"""Correction for many tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.operators.ranges import running_sums, suffix_minimum, with_value_range


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", out: str = "q_value") -> DataFrame:
    """False-discovery-rate q-values; a null or NaN p passes through as null.

    Equal p-values share a q-value, so the work is done once per distinct p, in value ranges.
    """
    usable = F.col(p).isNotNull() & ~F.isnan(F.col(p))
    distinct = tests.where(usable).groupBy(F.col(p).cast("double").alias("__p")).agg(
        F.count("*").alias("__n")
    )
    ranked = running_sums(with_value_range(distinct, "__p"), (), "__p", {"__rank": "__n"})
    m = distinct.agg(F.sum("__n")).scalar()
    scaled = ranked.withColumn("__ratio", F.col("__p") * m / F.col("__rank"))
    q = suffix_minimum(scaled, "__p", "__ratio", "__q").select(
        "__p", F.least(F.col("__q"), F.lit(1.0)).alias(out)
    )
    # unknown p-values get keys below zero, which match nothing and spread over the tasks
    spread = -1.0 - F.pmod(F.xxhash64(*tests.columns), F.lit(10_000))
    key = F.when(usable, F.col(p).cast("double")).otherwise(spread)
    return tests.join(q, key == q["__p"], "left").drop("__p")


def multiple_testing(tests: DataFrame, p: str = "p_value",
                     alpha: float = fixed.ALPHA) -> DataFrame:
    """Tests with q-values and decisions, ordered by p with unknown p last."""
    decided = benjamini_hochberg(tests, p).withColumns({
        "reject_raw": F.coalesce(F.col(p) < alpha, F.lit(False)),
        "reject_fdr": F.coalesce(F.col("q_value") < alpha, F.lit(False)),
    })
    return decided.orderBy(F.col(p).asc_nulls_last())


def testing_summary(decided: DataFrame, p: str = "p_value") -> DataFrame:
    return decided.agg(
        F.count(p).alias("n_tested"), F.count_if("reject_raw").alias("n_sig_raw"),
        F.count_if("reject_fdr").alias("n_sig_fdr"),
    )

"""Harrell's concordance index without forming pairs.

Risks are replaced by dense ranks and a binary tree is laid over the ranks. Two subjects
with different ranks part at exactly one level of that tree, one in the left and one in the
right child of the same node. So the comparable pairs of a level are counted per node by a
running sum over time, on a table that holds each (node, day) once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.functions.numbers import ratio
from cohortmill.operators.ranges import running_sums, with_value_range
from cohortmill.session import materialize


def _later(node: tuple[str, ...], time: str, total: str, censored: str):
    """Rows of a node that outlive a death on this day: later ones, and same-day leavers."""
    after = Window.partitionBy(*node).orderBy(F.col(time).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return F.coalesce(F.sum(total).over(after), F.lit(0)) + F.col(censored)


def risk_ranks(rows: DataFrame, risk: str, time: str, event: str) -> DataFrame:
    """Subjects counted per (dense risk rank, day)."""
    counted = rows.groupBy(F.col(risk).cast("double").alias("__risk"), time).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("bigint")).alias("d")
    )
    distinct = with_value_range(counted.select("__risk").distinct(), "__risk")
    ranks = running_sums(
        distinct.withColumn("__one", F.lit(1).cast("bigint")), (), "__risk", {"rank": "__one"}
    ).select("__risk", (F.col("rank") - 1).alias("rank"))
    return counted.join(ranks, "__risk").select("rank", time, "n", "d")


def concordance_counts(rows: DataFrame, risk: str = "risk", time: str = "time",
                       event: str = "event") -> DataFrame:
    """One row: comparable pairs, concordant pairs and pairs tied in risk."""
    usable = rows.where(F.col(risk).isNotNull() & F.col(time).isNotNull()
                        & F.col(event).isNotNull())
    ranked = materialize(risk_ranks(usable, risk, time, event))

    same = ranked.withColumn("__c", F.col("n") - F.col("d"))
    tied = same.withColumn("later", _later(("rank",), time, "n", "__c")).agg(
        F.coalesce(F.sum(F.col("d") * F.col("later")), F.lit(0)).alias("tied")
    )
    day = ranked.groupBy(time).agg(F.sum("n").alias("n"), F.sum("d").alias("d")).withColumn(
        "__c", F.col("n") - F.col("d"))
    comparable = day.withColumn("later", _later((), time, "n", "__c")).agg(
        F.coalesce(F.sum(F.col("d") * F.col("later")), F.lit(0)).alias("comparable")
    )

    # 2^depth leaves hold every rank; the depth grows with the logarithm of the cohort
    depth = ranked.agg(F.ceil(F.log2(F.max("rank") + F.lit(1.0))).cast("int")).first()[0] or 0
    if depth:
        levels = F.array(*[
            F.struct(F.lit(i).alias("level"),
                     F.shiftrightunsigned("rank", i + 1).alias("node"),
                     F.shiftrightunsigned("rank", i).bitwiseAND(1).alias("right"))
            for i in range(depth)
        ])
        right = F.col("right") == 1
        nodes = ranked.select("*", F.inline(levels)).groupBy("level", "node", time).agg(
            F.sum(F.when(right, 0).otherwise(F.col("n"))).alias("left_n"),
            F.sum(F.when(right, 0).otherwise(F.col("n") - F.col("d"))).alias("left_c"),
            F.sum(F.when(right, F.col("d")).otherwise(0)).alias("right_d"),
        )
        concordant = nodes.withColumn(
            "later", _later(("level", "node"), time, "left_n", "left_c")
        ).agg(F.coalesce(F.sum(F.col("right_d") * F.col("later")), F.lit(0)).alias("concordant"))
    else:
        concordant = ranked.agg(F.lit(0).cast("bigint").alias("concordant"))
    return comparable.select(
        "comparable", concordant.scalar().alias("concordant"), tied.scalar().alias("tied")
    )


def concordance_index(rows: DataFrame, risk: str = "risk", time: str = "time",
                      event: str = "event") -> DataFrame:
    """Adds c_index: concordant pairs plus half the ties over comparable pairs."""
    counts = concordance_counts(rows, risk, time, event)
    return counts.withColumn(
        "c_index",
        ratio(F.col("concordant") + F.lit(0.5) * F.col("tied"), F.col("comparable")),
    )

"""Ordered work without one task per group: ranks, running sums and exact quantiles.

A window over a whole group puts that group on one task, and a group may hold a third
of all rows. Here the rows are first cut into ranges of about equal row counts: by value
(``with_value_range``, equal values stay together) or by the full order
(``with_order_range``, which also splits tied values). Totals per (group, range) are small
and carry the offsets; the windows then run inside one (group, range) only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.session import broadcast_if_small, materialize, range_count

RANGE = "value_range"


def with_value_range(df: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """Adds the number of the value range each row falls in; equal values share one.

    The cut points come from a bounded quantile sketch, so only a short list of numbers
    reaches the driver.
    """
    ranges = ranges or range_count(df)
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.approxQuantile(value, steps, 1.0 / (4 * ranges)))) or [0.0]
    splits = [float("-inf"), *cuts, float("inf")]
    model = Bucketizer(splits=splits, inputCol=value, outputCol=RANGE, handleInvalid="error")
    return model.transform(df).withColumn(RANGE, F.col(RANGE).cast("int"))


def with_order_range(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the number of the range each row falls in by keys and full order.

    Rows tied in the first order columns are cut by the next ones, so a value that most rows
    share is split too. The cuts come from a sample; the result is stored, so that every later
    step sees the same cuts.
    """
    cut = df.repartitionByRange(range_count(df), *keys, *order)
    return materialize(cut.withColumn(RANGE, F.spark_partition_id()))


def _slot(keys: Sequence[str]) -> Column:
    """Group and range as one value; structs compare null keys as equal."""
    return F.struct(*[F.col(k) for k in [*keys, RANGE]]).alias("__slot")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    sums: Mapping[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums per group in the given order.

    ``df`` carries RANGE, and (keys, order) is unique in it. ``sums`` maps each new column
    to the column it accumulates. Within a group RANGE must rise with the order. The join with
    the offsets and the windows share one partitioning by (group, range).
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    towards = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    range_first = F.col(RANGE).desc() if descending else F.col(RANGE).asc()
    columns = [F.col(c) for c in df.columns]

    slotted = df.select(*columns, _slot(keys))
    totals = slotted.groupBy("__slot").agg(
        *[F.sum(source).alias(f"__{out}") for out, source in sums.items()]
    ).select("__slot", "__slot.*", *[f"__{out}" for out in sums])
    before = Window.partitionBy(*keys).orderBy(range_first).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        "__slot", *[F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in sums]
    )
    inside = Window.partitionBy("__slot").orderBy(*towards).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return slotted.join(offsets, "__slot").select(
        *columns,
        *[(F.sum(s).over(inside) + F.col(f"__{o}")).alias(o) for o, s in sums.items()],
    )


def ordinal_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank"
) -> DataFrame:
    """1-based rank of every row per group by a full order."""
    ranged = with_order_range(df, keys, order).withColumn("__one", F.lit(1).cast("bigint"))
    return running_sums(ranged, keys, order, {out: "__one"}).drop(RANGE, "__one")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str = "rank") -> DataFrame:
    """Rank of every row per group by ``value``; tied rows share the mean of their ranks.

    Ranges are cut by (value, ``tie``), so a value that most rows share is split over many tasks. Only
    the first and last value of a range can go on in another one; their counts are carried over
    the ranges, a row per range and value. Nulls come first and tie.
    """
    keys = list(keys)
    columns = [F.col(c) for c in df.columns]
    slotted = with_order_range(df, keys, [value, tie]).select(*columns, _slot(keys))
    ends = slotted.groupBy("__slot").agg(
        F.count("*").alias("__n"), F.min(F.struct(value))[value].alias("__low"), F.max(F.struct(value))[value].alias("__high"))
    before = Window.partitionBy(*[F.col(f"__slot.{k}") for k in keys]).orderBy(F.col(f"__slot.{RANGE}")).rowsBetween(
        Window.unboundedPreceding, -1)
    ends = materialize(ends.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    edges = ends.select("*", F.explode(F.array_distinct(F.array(
        F.struct(F.col("__low").alias(value)), F.struct(F.col("__high").alias(value))))).alias("__value"))
    marked = slotted.withColumn("__value", F.struct(value))
    tied = marked.join(broadcast_if_small(edges.select("__slot", "__value")), ["__slot", "__value"]).groupBy(
        "__slot", "__value").agg(F.count("*").alias("__ties"))
    # a range's first value starts with the range, its last one ends with it
    first = F.struct(F.col("__low").alias(value)).eqNullSafe(F.col("__value"))
    start = F.when(first, F.col("__offset")).otherwise(F.col("__offset") + F.col("__n") - F.col("__ties"))
    group = Window.partitionBy(*[F.col(f"__slot.{k}") for k in keys], "__value")
    carried = broadcast_if_small(edges.join(tied, ["__slot", "__value"]).withColumn("__start", start).select(
        "__slot", "__value", F.min("__start").over(group).alias("__first"), F.sum("__ties").over(group).alias("__all")))
    inside = Window.partitionBy("__slot")
    placed = marked.join(
        broadcast_if_small(ends.select("__slot", "__offset")), "__slot").select(
        *columns, "__slot", "__value",
        (F.col("__offset") + F.rank().over(inside.orderBy(value)) - 1).alias("__start"),
        F.count("*").over(Window.partitionBy("__slot", value)).alias("__ties"))
    return placed.join(carried, ["__slot", "__value"], "left").select(
        *columns, (F.coalesce("__first", "__start") + (F.coalesce("__all", "__ties") + 1) / 2).alias(out))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    weight: str | None = None,
    count: str | None = None,
    nearest: bool = False,
) -> DataFrame:
    """Exact quantiles per group, one column per entry: linearly interpolated, or with ``nearest``
    the value of the nearest rank, the higher one of two.

    Rows are counted per (group, range); only the ranges that hold a wanted rank are read
    again and ordered. ``weight`` counts a row several times. Null and NaN are left out.
    The needed columns are stored first, since they are read three times.
    """
    keys = list(keys)
    one = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = materialize(
        df.select(*keys, F.col(value).cast("double").alias("__v"), one.alias("__n"))
        .where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    )
    ranged = with_value_range(rows, "__v").select(_slot(keys), "__v", "__n")
    per_range = ranged.groupBy("__slot").agg(F.sum("__n").alias("__n")).select(
        "__slot", "__slot.*", "__n")

    group = Window.partitionBy(*keys)
    upto = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("__total") - 1
    wanted = F.array_distinct(F.array(*[
        rank.cast("bigint")
        for p in probabilities.values()
        for rank in ((F.floor(last * F.lit(p) + 0.5),) if nearest else (F.floor(last * F.lit(p)), F.ceil(last * F.lit(p))))
    ]))
    # at most two ranges per probability and group
    spans = broadcast_if_small(
        per_range
        .withColumn("__upto", F.sum("__n").over(upto))
        .withColumn("__total", F.sum("__n").over(group))
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .withColumn(
            "__ranks",
            F.filter(wanted, lambda r: (r >= F.col("__before")) & (r < F.col("__upto"))),
        )
        .where(F.size("__ranks") > 0)
        .select("__slot", "__before", "__ranks", "__total")
    )
    kept = ranged.join(spans, "__slot", "left_semi").groupBy("__slot", "__v").agg(
        F.sum("__n").alias("__n")
    )
    inside = Window.partitionBy("__slot").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = (
        kept.join(spans, "__slot")
        .withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
        .withColumn("__start", F.col("__end") - F.col("__n"))
        .select("__slot.*", "__total", "__v", F.explode(F.filter(
            "__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__end"))
        )).alias("__rank"))
    )
    found = placed.groupBy(*keys).agg(
        F.max("__total").alias("__total"),
        F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"),
    )
    out = []
    for name, p in probabilities.items():
        place = F.floor(last * F.lit(p) + 0.5) if nearest else last * F.lit(p)
        low = F.try_element_at("__at", F.floor(place).cast("bigint"))
        high = F.try_element_at("__at", F.ceil(place).cast("bigint"))
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    if count:
        out.append(F.col("__total").alias(count))
    return found.select(*keys, *out)


def suffix_minimum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Smallest ``value`` among rows at or after each row; ``df`` carries RANGE."""
    later = Window.orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, so this window is small
    per_range = df.groupBy(RANGE).agg(F.min(value).alias("__min")).select(
        RANGE, F.min("__min").over(later).alias("__later")
    )
    inside = Window.partitionBy(RANGE).orderBy(F.col(order).desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        df.join(per_range, RANGE)
        .withColumn(out, F.least(F.min(value).over(inside), F.col("__later")))
        .drop("__later")
    )

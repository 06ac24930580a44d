"""Quantiles of growing data by mergeable sketches.

A KLL sketch holds a bounded sample of a column's values with weights. Sketches merge, so the
quantiles of all files come from one small sketch per file and group, kept beside the cells; new
files add sketches and no old cell is read again. An estimated quantile's rank differs from the
wanted one by at most ``rank_error(k)`` of the rows, with 99 % confidence. Exact quantiles
(``ranges.quantiles``) remain the default everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.numbers import finite

K = 400


def rank_error(k: int = K) -> float:
    """Bound of the rank error, as a share of the rows (99 % confidence)."""
    return 2.296 / k ** 0.9021


def sketch_values(cells: DataFrame, keys: Sequence[str], value: str = "value", k: int = K) -> DataFrame:
    """(keys, sketch, n): a sketch of the finite values of each group, and how many there are."""
    x = finite(F.col(value))
    return cells.select(*keys, x.alias("__x")).where("__x is not null").groupBy(*keys).agg(
        F.kll_sketch_agg_double("__x", F.lit(k)).alias("sketch"), F.count("*").alias("n"))


def add_sketches(cells: DataFrame, path: str, keys: Sequence[str], batch: str, value: str = "value", k: int = K) -> None:
    """Stores the sketches of new cells under a name; adding a name again replaces what it holds."""
    sketch_values(cells, keys, value, k).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """One sketch per group out of any number of them."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float], k: int = K) -> DataFrame:
    """Estimated quantiles per group, one column per entry, and ``n``. Groups without finite values
    have no row."""
    return merged(sketches, keys, k).select(*keys, "n", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probabilities.items()])

"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double; the sum with zero turns -0.0 into 0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def log2p1(c: Column) -> Column:
    return F.log2(c.cast("double") + F.lit(1.0))


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    x = c.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), F.nanvl(x, F.lit(None).cast("double")))


def log2p1_clipped(c: Column) -> Column:
    """log2(x+1) with missing or non-finite values and negatives read as zero."""
    return F.log2(F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)) + F.lit(1.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * ratio(part, whole)


def banded(value: Column, green: Column, yellow: Column) -> Column:
    """green / yellow / red by two conditions."""
    return F.when(green, "green").when(yellow, "yellow").otherwise("red")

"""One row per key. Every choice is a mergeable aggregate, so a hot key stays cheap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """The smallest row (column by column) of each key."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("__row")
    ).select(key, "__row.*")


def last_per_key(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, position).alias(value))


def chosen_files(files: DataFrame, strategy: str = "fail", sample: str = "sample_id",
                 path: str = "file", total: str = "total") -> DataFrame:
    """One file per sample: the deepest (ties by path), the first by path, or an error."""
    if strategy == "deepest":
        pick = F.min_by(F.struct(path, total), F.struct(-F.col(total), path))
    elif strategy == "first":
        pick = F.min_by(F.struct(path, total), F.col(path))
    elif strategy == "fail":
        repeated = files.groupBy(sample).count().where("count > 1").orderBy(sample)
        names = [str(r[0]) for r in repeated.limit(20).collect()]
        if names:
            raise ValueError(f"samples with several files: {names}")
        pick = F.min_by(F.struct(path, total), F.col(path))
    else:
        raise ValueError(f"unknown strategy {strategy!r}; use deepest, fail or first")
    return files.groupBy(sample).agg(
        pick.alias("__pick"), F.count("*").alias("n_files")
    ).select(sample, "__pick.*", "n_files")


def deepest_sample_per_case(totals: DataFrame, case: str = "case_id", sample: str = "sample_id",
                            total: str = "total") -> DataFrame:
    """The sample with the largest total of each case (ties by sample id)."""
    return totals.groupBy(case).agg(
        F.min_by(F.struct(sample, total), F.struct(-F.col(total), sample)).alias("__pick")
    ).select(case, "__pick.*")

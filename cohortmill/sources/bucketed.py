"""Tables stored in buckets of a key, so that joins on it move nothing.

A matrix, a sample sheet and a cohort in as many buckets of the same key are joined bucket by bucket:
neither side is shuffled or, with one file a bucket, sorted. A side that is not stored so is dealt to the
other's buckets, and only it moves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.session import new_table


def save_bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None, name: str | None = None) -> str:
    """Stores ``df`` as a table in buckets of ``key`` and returns its name in the session's catalog.

    Rows are dealt to their buckets first: one file a bucket, and no key in two. Without a path the
    table lies in the shared folder.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or new_table(df.sparkSession, name)
    (df.repartition(buckets, F.col(key)).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return name


def joined(left: str, right: DataFrame | str, key: str, how: str = "inner", spark=None) -> DataFrame:
    """A stored table joined on its bucket key with another one, or with any rows."""
    spark = spark or right.sparkSession
    return spark.table(left).join(spark.table(right) if isinstance(right, str) else right, key, how)

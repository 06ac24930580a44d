"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "cohortmill", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # keeps all cores busy on small inputs; large ones follow the advisory size
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        # a checkpoint goes when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster other
    machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortmill-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, read many times, safe when executors are lost."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, *cluster_by: str) -> DataFrame:
    """The rows as a parquet table in the shared folder, read back with column pruning.

    ``cluster_by`` keeps equal values together, so later aggregates by them shrink before
    they are shuffled. The rebalance hint lets Spark split a value that holds many rows.
    """
    if cluster_by:
        df = df.hint("rebalance", *[F.col(c) for c in cluster_by]).sortWithinPartitions(
            *cluster_by)
    path = new_table(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, computed once, with a broadcast hint when its measured size is within ``limit``.

    Spark cannot know the size of an aggregate before it runs and would shuffle the large side
    of a join for it. Above the limit the join is left to Spark (sort-merge with skew splits).
    """
    kept = materialize(df)
    texts = [f.name for f in kept.schema if f.dataType.simpleString() == "string"]
    text_bytes = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in texts), F.lit(0))
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(text_bytes), F.lit(0))).first()
    return F.broadcast(kept) if rows * 16 * len(kept.columns) + size <= limit else kept


def range_count(df: DataFrame) -> int:
    """How many value ranges an ordered operator splits its input into."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

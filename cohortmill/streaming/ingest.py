"""Incremental reading of quantification files: every file is parsed once, checked, and kept once.

Files arrive in a folder. Each run takes the files that are new, one micro-batch or several; a batch
is judged file by file and committed under its number:

* ``rows``: the cells of good files, a folder per batch.
* ``quarantine``: the cells of bad files as they were read, with the file's problems.
* ``files``: a row per file, with its status, counts and problems. Written last, so that it lists
  only what is whole.

Committing a batch replaces the folders of its number, so a batch that is run again after a failure
adds nothing. A file name that an earlier batch has already kept is not kept twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from cohortmill.functions import clinical as FC
from cohortmill.functions import fixed
from cohortmill.functions.identifiers import file_stem
from cohortmill.operators.filters import RNASEQ, Modality
from cohortmill.session import broadcast_if_small, materialize
from cohortmill.sources.quantification import ID_PREFIX, LAYOUT, name_glob

BATCH = "batch"
FILE_SCHEMA = ("file string, status string, n_rows bigint, n_foreign bigint, n_repeated bigint, "
               "n_malformed bigint, example string")


def quantification_stream(spark: SparkSession, path: str, modality: Modality = RNASEQ, glob: str | None = "",
                          file: Column | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The text columns of files as they arrive below ``path``, with the stem of their file."""
    columns = LAYOUT[modality.id][0]
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = (
        spark.readStream.schema(schema).option("sep", "\t").option("header", True)
        .option("comment", "#").option("quote", "").option("enforceSchema", False)
        .option("recursiveFileLookup", True)
    )
    glob = name_glob(modality) if glob == "" else glob
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    text = (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)
    stem = file if file is not None else file_stem(F.col("_metadata.file_name"), modality.file_suffixes)
    return text.select(stem.alias("file"), *[F.col(f"`{c}`") for c in columns])


def lenient_rows(text: DataFrame, modality: Modality = RNASEQ) -> DataFrame:
    """Typed rows as ``typed_rows`` gives them, but numbers that do not parse become null and are
    counted in ``n_bad``; summary rows are dropped."""
    columns, counts, names = LAYOUT[modality.id]
    known = FC.nullify(text, fixed.QUANTIFICATION_NULLS, list(columns))
    if modality.id == RNASEQ.id:
        known = known.where(~F.coalesce(F.col("gene_id").isin(*fixed.RNA_SUMMARY_ROWS), F.lit(False)))
    kinds = {c: "bigint" if c in counts else "double" for c in columns if c not in names}
    bad = [(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).cast("int") for c, k in kinds.items()]
    return known.withColumn("n_bad", sum(bad[1:], bad[0])).withColumns(
        {c: F.col(f"`{c}`").try_cast(k) for c, k in kinds.items()})


def judge_files(rows: DataFrame, modality: Modality = RNASEQ) -> DataFrame:
    """A row per file (``FILE_SCHEMA``): accepted, or quarantined for ids with a foreign prefix, ids
    that occur twice, missing ids, or numbers that do not parse."""
    key = F.col(f"`{modality.feature_column}`")
    per_id = rows.groupBy("file", key.alias("id")).agg(F.count("*").alias("n"), F.sum("n_bad").alias("bad"))
    foreign = ~F.coalesce(F.col("id").startswith(ID_PREFIX[modality.id]), F.lit(False))
    broken = foreign | (F.col("n") > 1) | (F.col("bad") > 0)
    counted = per_id.groupBy("file").agg(
        F.sum("n").alias("n_rows"), F.count_if(foreign).alias("n_foreign"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.sum("bad").alias("n_malformed"), F.min(F.when(broken, F.coalesce("id", F.lit("")))).alias("example"))
    problems = F.col("n_foreign") + F.col("n_repeated") + F.col("n_malformed")
    return counted.select("file", F.when(problems > 0, "quarantined").otherwise("accepted").alias("status"),
                          "n_rows", "n_foreign", "n_repeated", "n_malformed", "example")


def _folder(out: str, what: str) -> str:
    return f"{out.rstrip('/')}/{what}"


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """The files committed so far, with the number of their batch; empty before the first."""
    schema = StructType.fromDDL(f"{FILE_SCHEMA}, {BATCH} bigint")
    try:
        return spark.read.schema(schema).parquet(_folder(out, "files"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def accepted_rows(spark: SparkSession, out: str) -> DataFrame:
    """The cells of accepted files of committed batches."""
    rows = spark.read.parquet(_folder(out, "rows"))
    # a row per batch
    whole = ledger(spark, out).select(BATCH).distinct()
    return rows.join(broadcast_if_small(whole), BATCH, "left_semi").drop(BATCH)


def commit_batch(text: DataFrame, batch: int, out: str, modality: Modality = RNASEQ) -> None:
    """Judges the files of a batch and replaces what is stored under its number."""
    spark = text.sparkSession
    rows = materialize(lenient_rows(text, modality))
    before = ledger(spark, out).where((F.col(BATCH) != batch) & (F.col("status") == "accepted")).select(
        "file", F.lit(True).alias("__known")).distinct()
    judged = materialize(judge_files(rows, modality).join(before, "file", "left").withColumn(
        "status", F.when(F.col("__known"), "repeated").otherwise(F.col("status"))).drop("__known"))

    def put(df: DataFrame, what: str) -> None:
        df.write.mode("overwrite").parquet(f"{_folder(out, what)}/{BATCH}={batch}")

    status = broadcast_if_small(judged.select("file", "status", "example"))
    marked = rows.join(status, "file")
    put(marked.where("status = 'accepted'").drop("status", "example", "n_bad"), "rows")
    put(marked.where("status <> 'accepted'"), "quarantine")
    put(judged, "files")


def ingest_new_files(spark: SparkSession, path: str, out: str, progress: str, modality: Modality = RNASEQ,
                     glob: str | None = "", file: Column | None = None, files_per_batch: int | None = None,
                     commit: Callable[[DataFrame, int, str, Modality], None] = commit_batch) -> StreamingQuery:
    """Parses, checks and commits every new file once, then stops.

    ``progress`` is the folder that remembers the batches; ``out`` holds ``rows``, ``quarantine`` and
    ``files``.
    """
    stream = quantification_stream(spark, path, modality, glob, file, files_per_batch)
    query = (
        stream.writeStream.foreachBatch(lambda text, batch: commit(text, batch, out, modality))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query

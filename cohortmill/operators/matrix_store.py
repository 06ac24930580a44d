"""A stored matrix that is kept up to date: new files replace the samples they bear on, no others.

Cells lie in folders by a hash of their sample, each with the file it came from and that file's
depth. Adding files compares them with what is stored, sample by sample; only the folders of samples
that change are written anew, by a dynamic partition overwrite. All other folders keep their files.
The result is that of building the matrix from all files at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.identifiers import file_stem
from cohortmill.operators.dedup import chosen_files
from cohortmill.operators.filters import RNASEQ, Modality, resolve_metric
from cohortmill.operators.joins import files_to_samples, stem_map, unmapped_files
from cohortmill.operators.matrix import file_totals
from cohortmill.session import broadcast_if_small, materialize, written

BUCKETS = 256
COLUMNS = ("sample_id", "feature_id", "value", "file", "total")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int")


def _write(cells: DataFrame, path: str, mode: str) -> None:
    # the hint splits a folder that holds many rows over several tasks
    (cells.hint("rebalance", F.col("bucket")).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def sample_cells(quantification: DataFrame, sheet: DataFrame, metric: str, strategy: str,
                 modality: Modality = RNASEQ, file: str = "file_name", feature: str | None = None) -> DataFrame:
    """(sample_id, feature_id, value, file, total) of the chosen file of every sample in the files.

    Files without a sheet row are an error, as in ``matrix.build_matrix``.
    """
    metric = resolve_metric(metric, modality.metrics)
    cells = quantification.select(F.col(file).alias("file"), F.col(feature or modality.feature_column).alias("feature_id"),
                                  F.col(metric).cast("double").alias("value"))
    totals = materialize(file_totals(cells).withColumn("stem", file_stem(F.col("file"), modality.file_suffixes)))
    stems = stem_map(sheet, modality.file_suffixes)
    lost = [r[0] for r in unmapped_files(totals, stems).limit(5).collect()]
    if lost:
        raise ValueError(f"files without a sample sheet row: {lost}")
    chosen = chosen_files(files_to_samples(totals, stems), strategy).select("file", "sample_id", "total")
    return cells.join(broadcast_if_small(chosen), "file").select(*COLUMNS)


def create(cells: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores the cells (``sample_cells``) as a new matrix; one that is there already is an error."""
    _write(cells.withColumn("bucket", _bucket(buckets)), path, "errorifexists")


def stored_cells(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, feature_id, value); reads only these columns."""
    return spark.read.parquet(path).select("sample_id", "feature_id", "value")


def stored_files(rows: DataFrame) -> DataFrame:
    """(sample_id, file, total): the file that every stored sample came from."""
    return rows.groupBy("sample_id").agg(F.min("file").alias("file"), F.min("total").alias("total"))


def add(cells: DataFrame, path: str, strategy: str = "fail", buckets: int = BUCKETS) -> DataFrame:
    """Adds the cells of new files (``sample_cells``) to a stored matrix; ``buckets`` must be those it
    was created with. A row per sample of the new files: ``outcome`` is new, replaced or kept.

    Of the stored and the new file of a sample the ``strategy`` chooses as for files read together;
    ``fail`` makes a sample that is in both an error. Files that are stored already change nothing.
    """
    spark = cells.sparkSession
    new = written(cells)  # the source may be costly, and is read twice
    arriving = materialize(stored_files(new).withColumn("bucket", _bucket(buckets)))
    # only the folders of arriving samples are read
    touched = spark.read.parquet(path).join(broadcast_if_small(arriving.select("bucket").distinct()), "bucket", "left_semi")
    here = materialize(stored_files(touched).join(arriving.select("sample_id", F.col("file").alias("arriving")), "sample_id"))
    known = here.where(F.col("file") == F.col("arriving")).select("sample_id")
    rivals = here.drop("arriving").unionByName(arriving.drop("bucket")).join(known, "sample_id", "left_anti")
    picked = materialize(chosen_files(rivals, strategy).join(here.select("sample_id", F.col("file").alias("before")), "sample_id", "left")
                         .select("sample_id", "file", "total", F.when(F.col("before").isNull(), "new")
                                 .when(F.col("before") == F.col("file"), "kept").otherwise("replaced").alias("outcome")))
    changed = broadcast_if_small(picked.where("outcome <> 'kept'").select("sample_id", _bucket(buckets).alias("bucket")))
    folders = broadcast_if_small(changed.select("bucket").distinct())
    if not folders.isEmpty():
        staying = (spark.read.parquet(path).join(folders, "bucket", "left_semi")
                   .join(changed.select("sample_id"), "sample_id", "left_anti").select(*COLUMNS, "bucket"))
        coming = new.join(changed, "sample_id").select(*COLUMNS, "bucket")
        # what is written again is stored first: the overwrite replaces folders that it was read from
        _write(written(staying.unionByName(coming)), path, "overwrite")
    same = arriving.join(known, "sample_id").select("sample_id", "file", "total", F.lit("kept").alias("outcome"))
    return picked.unionByName(same)

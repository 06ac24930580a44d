"""Quantification files: one file per sample, read as one table."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortmill.functions import clinical as FC
from cohortmill.functions import fixed
from cohortmill.functions.identifiers import file_stem
from cohortmill.operators.filters import MIRNA, RNASEQ, Modality, drop_summary_rows, require_columns

LAYOUT = {
    RNASEQ.id: (fixed.RNA_COLUMNS, fixed.RNA_COUNT_COLUMNS, ("gene_id", "gene_name", "gene_type")),
    MIRNA.id: (fixed.MIRNA_COLUMNS, ("read_count",), ("miRNA_ID", "cross-mapped")),
}
ID_PREFIX = {RNASEQ.id: "ENSG", MIRNA.id: "hsa-"}


def name_glob(modality: Modality = RNASEQ) -> str:
    """One glob for every file-name convention of the modality."""
    return "{" + ",".join("*" + s for s in modality.file_suffixes) + "}"


def _reader(spark: SparkSession, modality: Modality, recursive: bool, glob: str | None):
    reader = (
        spark.read.option("sep", "\t").option("header", True).option("comment", "#")
        .option("quote", "").option("recursiveFileLookup", recursive)
    )
    return reader.option("pathGlobFilter", glob) if glob else reader


def _header(spark: SparkSession, path: str, modality: Modality, recursive: bool, glob: str | None) -> list[str]:
    """The header of the first file with rows; without a schema Spark would list every file twice for it."""
    row = _reader(spark, modality, recursive, glob).schema("line string").csv(path).select("_metadata.file_path").first()
    one = re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(row[0])) if row else path
    return _reader(spark, modality, recursive, glob).csv(one).columns


def typed_rows(text: DataFrame, modality: Modality = RNASEQ) -> DataFrame:
    """Text columns with missing markers as null, counts as whole numbers, measures as doubles;
    summary rows dropped. Other columns of ``text`` are kept."""
    columns, counts, names = LAYOUT[modality.id]
    require_columns(text, columns, "quantification file")
    known = FC.nullify(text, fixed.QUANTIFICATION_NULLS, list(columns))
    if modality.id == RNASEQ.id:
        known = drop_summary_rows(known)
    kinds = {c: "bigint" if c in counts else "double" for c in columns if c not in names}
    return known.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items()})


def read_quantification(spark: SparkSession, path: str, modality: Modality = RNASEQ,
                        recursive: bool = True, glob: str | None = "",
                        file: Column | None = None) -> DataFrame:
    """All files below ``path`` with the stem of their file, typed.

    The header of the first file gives the columns; a file with another header is an error.
    """
    glob = name_glob(modality) if glob == "" else glob
    header = _header(spark, path, modality, recursive, glob)
    columns = LAYOUT[modality.id][0]
    missing = sorted(set(columns) - set(header))
    if missing:
        raise ValueError(f"quantification files in {path} lack columns: {missing}")
    schema = StructType([StructField(c, StringType()) for c in header])
    text = _reader(spark, modality, recursive, glob).schema(schema).option(
        "enforceSchema", False).csv(path)
    stem = file if file is not None else file_stem(
        F.col("_metadata.file_name"), modality.file_suffixes)
    return typed_rows(
        text.select(stem.alias("file"), *[F.col(f"`{c}`") for c in columns]), modality)


def quantification_problems(rows: DataFrame, modality: Modality = RNASEQ) -> DataFrame:
    """Per file: ids with a foreign prefix and ids that occur twice. No row means no problem."""
    feature = F.col(f"`{modality.feature_column}`")
    per_id = rows.groupBy("file", feature.alias("id")).agg(F.count("*").alias("n"))
    foreign = ~F.col("id").startswith(ID_PREFIX[modality.id])
    return per_id.where(foreign | (F.col("n") > 1)).groupBy("file").agg(
        F.count_if(foreign).alias("n_foreign"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.min("id").alias("example"),
    )


def checked(rows: DataFrame, modality: Modality = RNASEQ) -> DataFrame:
    bad = [r.asDict() for r in quantification_problems(rows, modality).limit(5).collect()]
    if bad:
        raise ValueError(f"quantification files with bad feature ids: {bad}")
    return rows


def line_balance(lines: DataFrame, file: str = "file", line: str = "value") -> DataFrame:
    """Per file: lines, comments, header, summary rows and the data rows that must remain."""
    text = F.col(line)
    comment = text.startswith("#")
    summary = F.lit(False)
    for name in fixed.RNA_SUMMARY_ROWS:
        summary = summary | text.startswith(name + "\t")
    counts = lines.groupBy(file).agg(
        F.count("*").alias("n_lines"), F.count_if(comment).alias("n_comments"),
        F.count_if(~comment & summary).alias("n_summary"),
    )
    header = F.when(F.col("n_lines") > F.col("n_comments"), 1).otherwise(0).cast("bigint")
    return counts.withColumn("n_header", header).withColumn(
        "n_expected",
        F.col("n_lines") - F.col("n_comments") - F.col("n_header") - F.col("n_summary"))


def read_lines(spark: SparkSession, path: str, modality: Modality = RNASEQ) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", name_glob(modality)).text(path)
    return text.select(file_stem(F.col("_metadata.file_name"), modality.file_suffixes)
                       .alias("file"), "value").where("value != ''")


def balance_check(balance: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected against parsed rows per file."""
    parsed = rows.groupBy("file").agg(F.count("*").alias("n_parsed"))
    return balance.join(parsed, "file", "left").withColumn(
        "balanced", F.col("n_expected") == F.coalesce("n_parsed", F.lit(0)))


def feature_dimension(rows: DataFrame) -> DataFrame:
    """Feature id, name and biotype, with a count of the biotypes a feature was given."""
    per = rows.groupBy("gene_id", "gene_name", "gene_type").agg(F.min("file").alias("file"))
    return per.groupBy("gene_id").agg(
        F.min_by("gene_name", "file").alias("gene_name"),
        F.min_by("gene_type", "file").alias("gene_type"),
        F.count_distinct("gene_type").alias("n_types"),
    )


def write_long(rows: DataFrame, path: str, by: str | None = None, fmt: str = "parquet",
               mode: str = "overwrite") -> None:
    """The parsed rows as parquet or csv; ``by`` makes one folder per value."""
    writer = rows.write.mode(mode)
    if by:
        writer = writer.partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_metric(spark: SparkSession, path: str, feature: str, metric: str,
                file: str = "file") -> DataFrame:
    """File, feature and one metric; parquet reads only these columns."""
    rows = spark.read.parquet(path)
    require_columns(rows, (file, feature, metric), path)
    return rows.select(file, F.col(f"`{feature}`").alias("feature_id"),
                       F.col(f"`{metric}`").alias("value"))

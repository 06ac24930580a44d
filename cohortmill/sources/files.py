"""Whole files: integrity and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: signatures that tell a file kind ---------------------------------
SUMMARY_MARKS = ("N_unmapped", "N_multimapping")
QUANTIFICATION_MARKS = ("gene_id", "tpm_unstranded")
CLINICAL_MARKS = ("cases.submitter_id", "demographic.vital_status",
                  "diagnoses.ajcc_pathologic_stage")
SHEET_MARKS = ("File ID", "File Name", "Case ID", "Sample ID")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and content of every file below ``path``; a file of 2 GiB or more is an error, for
    those see ``byte_files.read_digests``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
                        F.col("length").alias("size"), "content")


def integrity(files: DataFrame, metadata: DataFrame, name: str = "file_name",
              md5: str = "md5sum", size: str = "file_size") -> DataFrame:
    """Expected files with the digest found; ``verified`` and ``status``.

    ``files`` holds a ``content``, or the ``digest`` and ``problem`` of ``byte_files.read_digests``,
    which has no limit of size. A file without an expected digest counts as verified once it is
    there; one that could not be read is unreadable.
    """
    streamed = "content" not in files.columns
    found = files.select(name, (F.col("digest") if streamed else F.md5("content")).alias("actual_md5"),
                         F.col("size").alias("actual_size"),
                         (F.col("problem").isNotNull() if streamed else F.lit(False)).alias("__failed"))
    rows = metadata.join(found, name, "left")
    here = F.col("actual_md5").isNotNull()
    same = F.coalesce(F.col("actual_md5") == F.col(md5), F.col(md5).isNull())
    return rows.withColumns({
        "verified": here & same,
        "size_matches": F.col("actual_size") == F.col(size),
        "status": F.when(F.coalesce("__failed", F.lit(False)), "unreadable").when(~here, "missing")
        .when(same, "present").otherwise("damaged"),
    }).drop("__failed")


def file_kind(text: Column) -> Column:
    """The kind of a delimited text by its header; the order of the tests matters."""
    lines = F.split(F.substring_index(text, "\n", 9), "\r?\n")  # the tests look at eight lines
    first = F.get(lines, F.lit(0))
    commented = first.startswith("#")
    header = F.when(commented & (F.size(lines) > 1), F.get(lines, F.lit(1))).otherwise(first)
    columns = F.split(header, "\t")
    opening = F.array_join(F.slice(lines, 1, 8), "\n")

    def has(name: str) -> Column:
        return F.array_contains(columns, name)

    summary = opening.contains(SUMMARY_MARKS[0]) | opening.contains(SUMMARY_MARKS[1])
    clinical = has(CLINICAL_MARKS[0]) | has(CLINICAL_MARKS[1]) | has(CLINICAL_MARKS[2])
    known = F.size(F.array_intersect(columns, F.array(*[F.lit(m) for m in SHEET_MARKS])))
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "unknown")
        .when(commented & F.lower(text).contains("gene-model"), "star")
        .when(summary, "star")
        .when(has(QUANTIFICATION_MARKS[0]) & has(QUANTIFICATION_MARKS[1]), "star")
        .when(clinical, "clinical")
        .when(known >= 3, "sample_sheet")
        .otherwise("unknown")
    )


def upload_check(files: DataFrame, expected: str, text: str = "text") -> DataFrame:
    """Kind of each file against the kind its place expects."""
    kind = file_kind(F.col(text))
    return files.withColumn("kind", kind).withColumns({
        "fits": F.col("kind") == expected,
        "hint": F.when(F.col("kind") == expected, "")
        .when(F.col("kind") == "unknown", "unrecognised layout")
        .otherwise(F.concat(F.lit("looks like "), F.col("kind"))),
    })

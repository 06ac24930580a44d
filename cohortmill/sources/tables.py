"""Sample sheet and clinical tables: read, check, derive, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions import clinical as FC
from cohortmill.functions import fixed
from cohortmill.functions import identifiers as FI
from cohortmill.operators.dedup import smallest_row_per_key
from cohortmill.operators.filters import require_columns

# --- fixed values: source column names --------------------------------------------
SHEET_NAMES = {
    "File ID": "file_id", "File Name": "file_name", "Case ID": "case_id",
    "Sample ID": "sample_id", "Tissue Type": "tissue_type",
}
CLINICAL_NAMES = {
    "cases.submitter_id": "case_submitter_id",
    "cases.primary_site": "primary_site",
    "demographic.vital_status": "vital_status",
    "demographic.days_to_death": "days_to_death",
    "demographic.age_at_index": "age_at_index",
    "demographic.gender": "gender",
    "demographic.race": "race",
    "diagnoses.days_to_last_follow_up": "days_to_last_follow_up",
    "diagnoses.ajcc_pathologic_stage": "ajcc_pathologic_stage",
}
PRIMARY_FLAG = "diagnoses.diagnosis_is_primary_disease"
CLINICAL_COLUMNS = (
    "case_submitter_id", "vital_status", "time", "event", "days_to_death",
    "days_to_last_follow_up", "age_at_index", "gender", "race", "ajcc_pathologic_stage",
    "primary_site",
)


def read_text_table(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """A tab-separated table with a header, every column as text."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


# ---- sample sheet -----------------------------------------------------------------

def sheet_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """Renamed sheet columns with the sample code and the tumor flag."""
    require_columns(raw, SHEET_NAMES, "sample sheet")
    names = list(SHEET_NAMES.values())
    rows = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in SHEET_NAMES.items()], *keep)
    return FC.nullify(rows, fixed.SHEET_NULLS, names).withColumns({
        "tcga_sample_code": FI.sample_code(F.col("sample_id")),
        "is_tumor": F.col("tissue_type") == "Tumor",
    })


def sheet_problems() -> Column:
    """Names of the columns of a sheet row that break their format; null values pass."""
    broken = {
        "file_id": ~FI.is_uuid(F.col("file_id")),
        "case_id": ~FI.is_case_id(F.col("case_id")),
        "sample_id": ~FI.is_sample_id(F.col("sample_id")),
        "tissue_type": ~F.col("tissue_type").isin(*fixed.TISSUE_TYPES),
    }
    return F.array_compact(F.array(*[F.when(c, n) for n, c in broken.items()]))


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A checked sample sheet with its row order in ``position``."""
    raw = read_text_table(spark, path).withColumn("position", F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id()))
    out = sheet_rows(raw, "position")
    bad = out.withColumn("problem", F.explode(sheet_problems())).groupBy("problem").agg(
        F.count("*").alias("n"), F.min("file_id").alias("example")).collect()
    if bad:
        raise ValueError(f"sample sheet {path}: {[tuple(r) for r in bad]}")
    repeated = out.groupBy("file_id").count().where("count > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"sample sheet {path}: repeated file_id {[r[0] for r in repeated]}")
    if out.isEmpty():
        raise ValueError(f"sample sheet {path} has no rows")
    return out


def sheet_from_metadata(metadata: DataFrame, project: str) -> DataFrame:
    """The portal's sample sheet, with tissue and sample type read from the sample code."""
    code = FI.sample_code(F.col("sample_id"))
    return metadata.select(
        F.col("file_id").alias("File ID"), F.col("file_name").alias("File Name"),
        F.col("data_type").alias("Data Type"),
        F.col("experimental_strategy").alias("Data Category"),
        F.lit(project).alias("Project ID"), F.col("case_submitter_id").alias("Case ID"),
        F.col("sample_id").alias("Sample ID"), FI.tissue_of_code(code).alias("Tissue Type"),
        FI.sample_type_of_code(code).alias("Sample Type"),
    )


# ---- clinical ---------------------------------------------------------------------

def clinical_rows(raw: DataFrame) -> DataFrame:
    """One row per case: primary diagnosis, lenient numbers, overall-survival time and event.

    Cases without an observation time are left out.
    """
    require_columns(raw, [*CLINICAL_NAMES, PRIMARY_FLAG], "clinical table")
    known = FC.nullify(raw.select(*[F.col(f"`{c}`") for c in [*CLINICAL_NAMES, PRIMARY_FLAG]]),
                       fixed.CLINICAL_NULLS)
    primary = known.where(F.col(f"`{PRIMARY_FLAG}`") == "true").select(
        *[F.col(f"`{old}`").alias(new) for old, new in CLINICAL_NAMES.items()])
    one = smallest_row_per_key(primary, "case_submitter_id").withColumns({
        "days_to_death": FC.whole_number(F.col("days_to_death")),
        "days_to_last_follow_up": FC.whole_number(F.col("days_to_last_follow_up")),
        "age_at_index": FC.whole_number(F.col("age_at_index"), via_double=False),
    })
    derived = one.withColumns({
        "event": FC.overall_survival_event(F.col("vital_status")),
        "time": FC.overall_survival_time(
            F.col("vital_status"), F.col("days_to_death"), F.col("days_to_last_follow_up")),
    })
    return derived.where(F.col("time").isNotNull()).select(*CLINICAL_COLUMNS)


def clinical_problems() -> Column:
    broken = {
        "case_submitter_id": ~FI.is_case_id(F.col("case_submitter_id")),
        "vital_status": ~F.col("vital_status").isin(*fixed.VITAL_STATUSES),
    }
    return F.array_compact(F.array(*[F.when(c, n) for n, c in broken.items()]))


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    rows = clinical_rows(read_text_table(spark, path))
    if rows.isEmpty():
        raise ValueError(f"clinical table {path}: no case with a primary diagnosis and a time")
    bad = rows.withColumn("problem", F.explode(clinical_problems())).groupBy("problem").agg(
        F.count("*").alias("n"), F.min("case_submitter_id").alias("example")).collect()
    if bad:
        raise ValueError(f"clinical table {path}: {[tuple(r) for r in bad]}")
    return rows.orderBy("case_submitter_id")

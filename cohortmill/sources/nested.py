"""Nested study metadata (JSON) as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions import identifiers as FI
from cohortmill.sources.json_arrays import read_elements

# --- fixed values: layouts of the exported documents --------------------------------
METADATA_SCHEMA = """file_id string, file_name string, md5sum string, file_size bigint,
  data_type string, experimental_strategy string,
  associated_entities array<struct<entity_submitter_id: string, entity_type: string,
    case_id: string, entity_id: string>>,
  analysis struct<workflow_type: string, workflow_version: string,
    input_files: array<struct<total_reads: bigint, proportion_reads_mapped: double,
      average_base_quality: double, average_read_length: double>>>"""
FILE_SCHEMA = """file_id string, file_name string, md5sum string, file_size bigint,
  data_type string, experimental_strategy string,
  cases array<struct<case_id: string, submitter_id: string,
    samples: array<struct<submitter_id: string, portions: array<struct<
      analytes: array<struct<aliquots: array<struct<aliquot_id: string,
        submitter_id: string>>>>>>>>>>,
  analysis struct<workflow_type: string, workflow_version: string>"""
CASE_SCHEMA = """submitter_id string, primary_site string,
  demographic struct<vital_status: string, days_to_death: bigint, age_at_index: bigint,
    gender: string, race: string>,
  diagnoses array<struct<diagnosis_is_primary_disease: boolean,
    days_to_last_follow_up: string, ajcc_pathologic_stage: string>>"""


def read_documents(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """JSON arrays of records, one row per record; a file of any size is read in parallel."""
    return parse_documents(read_elements(spark, path, (), **options), "text", schema)


def read_hits(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Response pages ``{"data": {"hits": [...]}}``, one row per hit, read as ``read_documents``."""
    return parse_documents(read_elements(spark, path, ("data", "hits"), **options), "text", schema)


def parse_documents(texts: DataFrame, text: str, schema: str, *keep: str) -> DataFrame:
    """JSON text as typed columns. The generator keeps the text from being parsed once per
    column that is read later."""
    return texts.select(*keep, F.inline(F.array(F.from_json(text, schema))))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


# ---- file metadata ----------------------------------------------------------------

def metadata_problem() -> Column:
    """What is wrong with a metadata record, or null."""
    barcode = _first(F.col("associated_entities"))["entity_submitter_id"]
    inputs = F.col("analysis.input_files")
    required = ("file_id", "file_name", "md5sum", "file_size", "data_type",
                "experimental_strategy")
    empty = F.lit(False)
    for c in required:
        empty = empty | F.col(c).isNull()
    return (
        F.when(empty, "missing field")
        .when(F.coalesce(F.size("associated_entities"), F.lit(0)) < 1, "no associated entity")
        .when(barcode.isNull() | ~FI.is_aliquot_id(barcode), "bad aliquot barcode")
        .when(F.coalesce(F.size(inputs), F.lit(0)) < 1, "no input file")
    )


def flatten_metadata(records: DataFrame) -> DataFrame:
    """17 flat columns per file from the first entity and the first input file."""
    entity = _first(F.col("associated_entities"))
    reads = _first(F.col("analysis.input_files"))
    barcode = entity["entity_submitter_id"]
    return records.where(metadata_problem().isNull()).select(
        "file_id", "file_name", "md5sum", "file_size", "data_type", "experimental_strategy",
        FI.sample_barcode(barcode).alias("sample_id"),
        FI.case_barcode(barcode).alias("case_submitter_id"),
        barcode.alias("aliquot_barcode"), entity["case_id"].alias("case_uuid"),
        entity["entity_id"].alias("aliquot_uuid"),
        F.col("analysis.workflow_type").alias("workflow_type"),
        F.col("analysis.workflow_version").alias("workflow_version"),
        reads["total_reads"].alias("total_reads"),
        reads["proportion_reads_mapped"].alias("proportion_reads_mapped"),
        reads["average_base_quality"].alias("average_base_quality"),
        reads["average_read_length"].alias("average_read_length"),
    )


# ---- file hits --------------------------------------------------------------------

def hit_problem() -> Column:
    """The first empty level of a file hit, or null."""
    case = _first(F.col("cases"))
    sample = _first(case["samples"])
    portion = _first(sample["portions"])
    analyte = _first(portion["analytes"])
    levels = {"cases": F.col("cases"), "samples": case["samples"],
              "portions": sample["portions"], "analytes": portion["analytes"],
              "aliquots": analyte["aliquots"]}
    missing = F.lit(False)
    for c in ("file_id", "file_name", "md5sum", "file_size"):
        missing = missing | F.col(c).isNull()
    out = F.when(missing, "missing field")
    for name, array in levels.items():
        out = out.when(F.coalesce(F.size(array), F.lit(0)) < 1, f"empty {name}")
    return out


def flatten_hits(hits: DataFrame) -> DataFrame:
    """13 flat columns per file; hits with an empty level are left to ``hit_problem``."""
    case = _first(F.col("cases"))
    sample = _first(case["samples"])
    aliquot = _first(_first(_first(sample["portions"])["analytes"])["aliquots"])

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return hits.where(hit_problem().isNull()).select(
        "file_id", "file_name", "md5sum", "file_size", text(F.col("data_type")).alias("data_type"),
        text(F.col("experimental_strategy")).alias("experimental_strategy"),
        text(sample["submitter_id"]).alias("sample_id"),
        text(case["submitter_id"]).alias("case_submitter_id"),
        text(aliquot["submitter_id"]).alias("aliquot_barcode"),
        text(case["case_id"]).alias("case_uuid"), text(aliquot["aliquot_id"]).alias("aliquot_uuid"),
        text(F.col("analysis.workflow_type")).alias("workflow_type"),
        text(F.col("analysis.workflow_version")).alias("workflow_version"),
    )


def require_unique(rows: DataFrame, key: str = "file_id") -> DataFrame:
    repeated = rows.groupBy(key).count().where("count > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"repeated {key}: {[r[0] for r in repeated]}")
    return rows


# ---- cases ------------------------------------------------------------------------

def case_problem() -> Column:
    """Why a case cannot be used; null when it can."""
    name = F.trim(F.col("submitter_id"))
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "missing submitter_id")


def flatten_cases(hits: DataFrame) -> DataFrame:
    """The portal's clinical text table: one row per case and diagnosis.

    A case without a diagnosis keeps one row. Missing values are empty text, flags are
    "true" and "false". Cases without an id are left to ``case_problem``.
    """
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    rows = hits.where(case_problem().isNull()).withColumn(
        "diagnosis", F.explode_outer("diagnoses"))
    who, what = F.col("demographic"), F.col("diagnosis")
    return rows.select(
        F.col("submitter_id").alias("cases.submitter_id"),
        text(F.col("primary_site")).alias("cases.primary_site"),
        *[text(who[c]).alias(f"demographic.{c}")
          for c in ("vital_status", "days_to_death", "age_at_index", "gender", "race")],
        *[F.lower(text(what[c])).alias(f"diagnoses.{c}") if c.startswith("diagnosis")
          else text(what[c]).alias(f"diagnoses.{c}")
          for c in ("diagnosis_is_primary_disease", "days_to_last_follow_up",
                    "ajcc_pathologic_stage")],
    )

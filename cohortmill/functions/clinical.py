"""Column expressions on clinical fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import fixed


def null_if_marker(c: Column, markers: tuple[str, ...] = fixed.CLINICAL_NULLS) -> Column:
    return F.when(~c.isin(*markers), c)


def nullify(df: DataFrame, markers: tuple[str, ...], columns: list[str] | None = None) -> DataFrame:
    """The missing-value markers replaced by null in every (string) column."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({n: null_if_marker(F.col(f"`{n}`"), markers) for n in names})


def canonical_text(c: Column) -> Column:
    """Every spelling of "missing" as the empty string, other text trimmed."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    for pattern in (r"^'?--$", r"^None$", r"^null$"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def whole_number(c: Column, via_double: bool = True) -> Column:
    """Lenient number: ``67.9`` becomes 67 (or null when read strictly), text becomes null."""
    return c.try_cast("double").try_cast("bigint") if via_double else c.try_cast("bigint")


def overall_survival_event(vital_status: Column) -> Column:
    return vital_status == "Dead"


def overall_survival_time(vital_status: Column, to_death: Column, to_last: Column) -> Column:
    return F.when(vital_status == "Dead", to_death).otherwise(to_last)


def stage_group(stage: Column) -> Column:
    """Detailed stage to I-IV. Only IV, IVA and IVB are stage IV; other IV* read as I."""
    short = F.regexp_replace(stage, "Stage ", "")
    return (
        F.when(short.isin("IV", "IVA", "IVB"), "IV")
        .when(short.startswith("III"), "III")
        .when(short.startswith("II"), "II")
        .when(short.startswith("I"), "I")
        .otherwise("Unknown")
    )


def stage_level(group: Column) -> Column:
    """I-IV as 1-4, anything else null."""
    level = F.array_position(F.array(*[F.lit(s) for s in fixed.MAIN_STAGES]), group)
    return F.nullif(level, F.lit(0)).cast("int")


def is_male(gender: Column) -> Column:
    """1 for male, 0 for everything else, a missing value included."""
    return F.coalesce(gender == "male", F.lit(False)).cast("int")


def years(days: Column) -> Column:
    return days / F.lit(fixed.DAYS_PER_YEAR)


def with_model_columns(cohort: DataFrame) -> DataFrame:
    """Adds time_years, stage_group, gender_male and stage_numeric."""
    return cohort.withColumns({
        "time_years": years(F.col("time")),
        "stage_group": stage_group(F.col("ajcc_pathologic_stage")),
        "gender_male": is_male(F.col("gender")),
    }).withColumn("stage_numeric", stage_level(F.col("stage_group")))

"""Column expressions on file names, barcodes and feature ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortmill.functions import fixed


def file_stem(name: Column, suffixes: tuple[str, ...] = fixed.RNA_FILE_SUFFIXES) -> Column:
    """Base name without its known suffix, or without its last extension."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    known = "(" + "|".join(re.escape(s) for s in suffixes) + ")$"
    plain = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    return F.when(base.rlike(known), F.regexp_replace(base, known, "")).otherwise(plain)


def sample_barcode(aliquot: Column) -> Column:
    return F.substring_index(aliquot, "-", 4)


def case_barcode(aliquot: Column) -> Column:
    return F.substring_index(aliquot, "-", 3)


def sample_code(sample: Column) -> Column:
    """The last three characters of a sample barcode, such as ``01A``."""
    return F.substring(sample, -3, 3)


def sample_code_strict(sample: Column) -> Column:
    """The trailing two-digit-one-letter code; null where the barcode has none."""
    return F.nullif(F.regexp_extract(sample, fixed.SAMPLE_CODE_PATTERN, 1), F.lit(""))


def site_code(sample: Column, strict: bool = True) -> Column:
    """Second barcode field; the strict form asks for a TCGA barcode. ``?`` if unknown."""
    second = F.get(F.split(sample, "-"), F.lit(1))
    if strict:
        first = F.get(F.split(sample, "-"), F.lit(0))
        second = F.when(F.upper(first) == "TCGA", second)
    return F.coalesce(second, F.lit("?"))


def site_slice(sample: Column) -> Column:
    """Characters six and seven, where a barcode keeps its site."""
    return F.substring(sample, 6, 2)


def base_feature(feature: Column) -> Column:
    """Feature id without its version suffix."""
    return F.split_part(feature, F.lit("."), F.lit(1))


def is_case_id(c: Column) -> Column:
    return c.rlike(fixed.CASE_PATTERN)


def is_sample_id(c: Column) -> Column:
    return c.rlike(fixed.SAMPLE_PATTERN)


def is_aliquot_id(c: Column) -> Column:
    return c.rlike(fixed.ALIQUOT_PATTERN)


def is_uuid(c: Column) -> Column:
    return c.rlike(fixed.UUID_PATTERN)


def _code_number(code: Column) -> Column:
    return F.when(F.length(code) >= 2, F.left(code, F.lit(2)).try_cast("int"))


def tissue_of_code(code: Column) -> Column:
    number = _code_number(code)
    return (
        F.when(number.between(1, 9), "Tumor")
        .when(number.between(10, 19), "Normal")
        .otherwise("Unknown")
    )


def sample_type_of_code(code: Column) -> Column:
    number = _code_number(code)
    return (
        F.when(number.isNull(), "Unknown")
        .when(number == 1, "Primary Tumor")
        .when(number == 2, "Recurrent Tumor")
        .when(number.between(3, 9), "Tumor")
        .when(number.between(10, 19), "Solid Tissue Normal")
        .otherwise("Other")
    )

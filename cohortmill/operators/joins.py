"""Joins between files, samples, cases and clinical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.functions.clinical import canonical_text
from cohortmill.functions.identifiers import case_barcode, file_stem
from cohortmill.operators.aggregates import completeness
from cohortmill.operators.dedup import last_per_key
from cohortmill.operators.ranges import ordinal_rank


def stem_map(sheet: DataFrame, suffixes: tuple[str, ...] = fixed.RNA_FILE_SUFFIXES,
             file_name: str = "file_name", sample: str = "sample_id",
             position: str = "position") -> DataFrame:
    """File stem to sample; the last sheet row of a stem counts."""
    stems = sheet.select(file_stem(F.col(file_name), suffixes).alias("stem"), sample, position)
    return last_per_key(stems, "stem", sample, position)


def files_to_samples(files: DataFrame, stems: DataFrame, stem: str = "stem") -> DataFrame:
    """Files with their sample; null where the sheet does not know the file."""
    return files.join(stems, stem, "left")


def unmapped_files(files: DataFrame, stems: DataFrame, stem: str = "stem") -> DataFrame:
    return files.select(stem).distinct().join(stems.select(stem), stem, "left_anti")


def attach_sheet(samples: DataFrame, sheet: DataFrame, sample: str = "sample_id",
                 columns: Sequence[str] = ("case_id", "tissue_type", "is_tumor"),
                 keep_fanout: bool = False) -> DataFrame:
    """Samples with their sheet columns.

    A sample with several files has several sheet rows; they are made distinct first unless
    ``keep_fanout`` asks for one result row per sheet row.
    """
    side = sheet.select(sample, *columns)
    return samples.join(side if keep_fanout else side.distinct(), sample, "left")


def attach_clinical(samples: DataFrame, clinical: DataFrame, case: str = "case_id",
                    clinical_case: str = "case_submitter_id",
                    columns: Sequence[str] = ("time", "event", *fixed.COVARIATES)) -> DataFrame:
    side = clinical.select(F.col(clinical_case).alias(case), *columns)
    return samples.join(side, case, "left")


def refresh_covariates(dataset: DataFrame, clinical: DataFrame,
                       columns: Sequence[str] = fixed.COVARIATES, case: str = "case_id",
                       clinical_case: str = "case_submitter_id") -> DataFrame:
    """The dataset with its covariates taken anew from clinical, column order kept."""
    present = [c for c in columns if c in clinical.columns]
    side = clinical.select(F.col(clinical_case).alias(case), *present)
    joined = dataset.drop(*columns).join(side, case, "left")
    return joined.select(*[c for c in dataset.columns if c in joined.columns])


def refresh_report(before: DataFrame, after: DataFrame, clinical: DataFrame,
                   columns: Sequence[str] = fixed.COVARIATES, case: str = "case_id",
                   clinical_case: str = "case_submitter_id") -> DataFrame:
    """Completeness per covariate before and after, and rows with a clinical match."""
    known = clinical.select(F.col(clinical_case).alias(case)).distinct()
    matched = after.join(known, case, "left_semi").agg(F.count("*")).scalar()
    old = completeness(before, columns).select("column", F.col("pct").alias("pct_before"))
    new = completeness(after, columns).select("column", F.col("pct").alias("pct_after"), "n")
    return old.join(new, "column").withColumn("matched", matched)


def count_comparison(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows per key in two sources. A key missing on one side is reported as such."""
    a = left.groupBy(F.col(key)).agg(F.count("*").alias("n_left"))
    b = right.groupBy(F.col(key)).agg(F.count("*").alias("n_right"))
    return a.join(b, key, "full").withColumn(
        "status",
        F.when(F.col("n_left").isNull(), "only_right")
        .when(F.col("n_right").isNull(), "only_left")
        .when(F.col("n_left") != F.col("n_right"), "different").otherwise("equal"),
    )


def cell_comparison(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str],
                    order: str, key_rows: bool = True) -> DataFrame:
    """Cells that differ between two sources after missing markers are made alike.

    Rows of a key are paired by their place in ``order`` (then by all columns). One row per
    differing cell: key, place, column, left_value, right_value.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        text = df.select(key, *[canonical_text(F.col(c)).alias(c) for c in columns])
        placed = ordinal_rank(
            text, [key], list(dict.fromkeys([order, *columns])), "place",
        ) if key_rows else text.withColumn("place", F.lit(1).cast("bigint"))
        return placed.select(key, "place", F.struct(*columns).alias(name))

    pairs = side(left, "a").join(side(right, "b"), [key, "place"])
    cells = pairs.select(key, "place", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("left_value"),
                 F.col(f"b.{c}").alias("right_value"))
        for c in columns
    ])))
    return cells.where(F.col("left_value") != F.col("right_value"))


def mismatch_summary(cells: DataFrame, key: str, examples: int = 3) -> DataFrame:
    """Differences per column, with the first few differing cells as examples.

    The row-number filter is applied before the shuffle, so a column with many differences
    sends only a few rows.
    """
    first = Window.partitionBy("column").orderBy(key, "place")
    shown = cells.withColumn("example", F.row_number().over(first)).where(
        F.col("example") <= examples
    )
    counts = cells.groupBy("column").agg(F.count("*").alias("n_diff"))
    return counts.join(shown, "column")


def agreement(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column, matched keys whose values agree (null agrees with null)."""
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key)
    counts = both.agg(F.count("*").alias("n"), *[
        F.count_if(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_equal"), F.col("n").alias("n"))
        for c in columns
    ])))


def with_feature_names(expression: DataFrame, features: DataFrame,
                       feature: str = "feature_id", name: str = "feature_name") -> DataFrame:
    return expression.join(features.select(feature, name), feature)


def clinical_lookup(samples: DataFrame, dataset: DataFrame, columns: Sequence[str],
                    sample: str = "sample_id", case: str = "case_id") -> DataFrame:
    """Clinical columns by sample id, else by the case part of the barcode."""
    row = F.struct(*columns)
    exact = dataset.groupBy(F.col(sample)).agg(F.min(row).alias("__exact"))
    by_case = dataset.groupBy(F.col(case).alias("__case")).agg(
        F.min_by(row, F.col(sample)).alias("__by_case")
    )
    found = (
        samples.join(exact, sample, "left")
        .withColumn("__case", case_barcode(F.col(sample)))
        .join(by_case, "__case", "left")
    )
    return found.select(
        *samples.columns,
        F.when(F.col("__exact").isNotNull(), "sample")
        .when(F.col("__by_case").isNotNull(), "case").otherwise("none").alias("match"),
        F.coalesce("__exact", "__by_case").alias("__row"),
    ).select(*samples.columns, "match", "__row.*")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key once with the side it is on: both, left or right."""
    a = left.select(key).distinct().withColumn("__l", F.lit(True))
    b = right.select(key).distinct().withColumn("__r", F.lit(True))
    return a.join(b, key, "full").select(
        key,
        F.when(F.col("__r").isNull(), "left").when(F.col("__l").isNull(), "right")
        .otherwise("both").alias("side"),
    )


def schema_difference(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    a, b = set(left.columns), set(right.columns)
    return {"both": sorted(a & b), "left": sorted(a - b), "right": sorted(b - a)}

"""Row and feature selection with an account of what was dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.functions.numbers import percent
from cohortmill.session import broadcast_if_small


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def resolve_metric(name: str, allowed: Sequence[str] = fixed.RNA_METRICS) -> str:
    """A metric column by its full name or short alias."""
    full = fixed.METRIC_ALIASES.get(name, name)
    if full not in allowed:
        raise ValueError(f"unknown metric {name!r}; aliases {sorted(fixed.METRIC_ALIASES)}, "
                         f"columns {sorted(allowed)}")
    return full


def select_metric(df: DataFrame, metric: str, keys: Sequence[str],
                  allowed: Sequence[str] = fixed.RNA_METRICS) -> DataFrame:
    return df.select(*keys, F.col(resolve_metric(metric, allowed)).alias("value"))


def drop_summary_rows(df: DataFrame, column: str = "gene_id",
                      rows: Sequence[str] = fixed.RNA_SUMMARY_ROWS) -> DataFrame:
    return df.where(~F.col(column).isin(*rows))


def is_short_censored(days: int, time: str = "time", event: str = "event") -> Column:
    """Left early without an event. Early events carry information and stay."""
    return (F.col(time) < days) & ~F.col(event)


def follow_up_filter(cohort: DataFrame, min_days: int = 0, drop_zero_time: bool = True,
                     time: str = "time", event: str = "event") -> DataFrame:
    kept = cohort.where(F.col(time).isNotNull())
    if drop_zero_time:
        kept = kept.where(F.col(time) > 0)
    if min_days > 0:
        kept = kept.where(~is_short_censored(min_days, time, event))
    return kept


def follow_up_steps(min_days: int = 0, drop_zero_time: bool = True, tumor: str | None = None,
                    time: str = "time", event: str = "event") -> dict[str, Column]:
    """The filters of a dataset build, in order, as named conditions."""
    steps = {"all": F.lit(True)}
    if tumor:
        steps["tumor"] = F.col(tumor)
    steps["time_known"] = F.col(time).isNotNull()
    if drop_zero_time:
        steps["time_positive"] = F.col(time) > 0
    if min_days > 0:
        steps["not_short_censored"] = ~is_short_censored(min_days, time, event)
    return steps


def funnel(rows: DataFrame, steps: Mapping[str, Column], case: str = "case_id",
           event: str = "event") -> DataFrame:
    """Rows, cases and events left after each step, from one scan.

    Rows are first counted per case, so distinct cases need no second pass.
    """
    passed, left = F.lit(True), {}
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        left[name] = passed
    per_case = rows.groupBy(case).agg(*[
        agg for i, c in enumerate(left.values())
        for agg in (F.count_if(c).alias(f"r{i}"), F.count_if(c & F.col(event)).alias(f"e{i}"))
    ])
    totals = per_case.agg(*[
        agg for i in range(len(left))
        for agg in (F.sum(f"r{i}").alias(f"r{i}"), F.count_if(F.col(f"r{i}") > 0).alias(f"c{i}"),
                    F.sum(f"e{i}").alias(f"e{i}"))
    ])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"),
                 F.col(f"r{i}").alias("rows"), F.col(f"c{i}").alias("cases"),
                 F.col(f"e{i}").alias("events"))
        for i, name in enumerate(left)
    ])))


def removal_report(rows: DataFrame, conditions: Mapping[str, Column], case: str = "case_id",
                   event: str = "event") -> DataFrame:
    """Rows, cases and events that meet each condition (not cumulative)."""
    per_case = rows.groupBy(case).agg(*[
        agg for i, c in enumerate(conditions.values())
        for agg in (F.count_if(c).alias(f"r{i}"), F.count_if(c & F.col(event)).alias(f"e{i}"))
    ])
    return per_case.agg(*[
        F.struct(F.sum(f"r{i}").alias("rows"), F.count_if(F.col(f"r{i}") > 0).alias("cases"),
                 F.sum(f"e{i}").alias("events")).alias(f"s{i}")
        for i in range(len(conditions))
    ]).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("condition"), F.col(f"s{i}.rows").alias("rows"),
                 F.col(f"s{i}.cases").alias("cases"), F.col(f"s{i}.events").alias("events"))
        for i, name in enumerate(conditions)
    ])))


def follow_up_outliers(cohort: DataFrame, short_days: int = 30, long_days: int = 5000,
                       time: str = "time") -> DataFrame:
    """Very short and very long follow-up, each list sorted from its extreme."""
    t = F.col(time)
    kind = F.when(t < short_days, "short").when(t > long_days, "long")
    listed = cohort.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return listed.orderBy(F.col("kind").desc(), F.when(t < short_days, t).otherwise(-t))


# ---- features ---------------------------------------------------------------------

def biotype_filter(expression: DataFrame, features: DataFrame, wanted: str,
                   biotype: str = "gene_type", feature: str = "feature_id") -> DataFrame:
    """Cells of features with the wanted biotype. An unknown biotype is an error."""
    kept = features.where(F.col(biotype) == wanted).select(feature)
    if kept.isEmpty():
        values = [r[0] for r in features.select(biotype).distinct().orderBy(biotype)
                  .limit(20).collect()]
        raise ValueError(f"biotype {wanted!r} leaves no feature; present: {values}")
    return expression.join(broadcast_if_small(kept.distinct()), feature, "left_semi")


def biotype_report(features: DataFrame, wanted: str, biotype: str = "gene_type") -> DataFrame:
    """Features per biotype with share, and whether the filter keeps them."""
    counts = features.groupBy(biotype).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        biotype, "n", percent(F.col("n"), total).alias("pct"),
        F.coalesce(F.col(biotype) == wanted, F.lit(False)).alias("kept"),
    )


def feature_subset(expression: DataFrame, wanted: DataFrame,
                   feature: str = "feature_id") -> DataFrame:
    """Cells of the wanted features; a wanted feature without cells is an error."""
    missing = missing_features(expression, wanted, feature).limit(6).collect()
    if missing:
        names = [str(r[0]) for r in missing]
        raise ValueError(f"features not in the matrix: {names[:5]}"
                         + ("..." if len(names) > 5 else ""))
    ids = broadcast_if_small(wanted.select(feature).distinct())
    return expression.join(ids, feature, "left_semi")


def missing_features(expression: DataFrame, wanted: DataFrame,
                     feature: str = "feature_id") -> DataFrame:
    present = expression.select(feature).distinct()
    return wanted.select(feature).join(present, feature, "left_anti").distinct().orderBy(feature)


# ---- modalities -------------------------------------------------------------------

@dataclass(frozen=True)
class Modality:
    """A kind of feature, told by the prefixes of its ids."""

    id: str
    label: str
    prefixes: tuple[str, ...]
    feature_column: str
    metrics: tuple[str, ...]
    default_metric: str
    file_suffixes: tuple[str, ...]
    data_type: str
    workflow: str

    def is_feature(self, c: Column) -> Column:
        found = F.lit(False)
        for p in self.prefixes:
            found = found | c.startswith(p)
        return found

    def portal_filters(self) -> dict[str, str]:
        return {"data_type": self.data_type, "workflow_type": self.workflow}


RNASEQ = Modality(
    "rnaseq", "Gene expression (RNA-seq)", ("ENSG",), "gene_id", fixed.RNA_METRICS,
    "unstranded", fixed.RNA_FILE_SUFFIXES, "Gene Expression Quantification", "STAR - Counts",
)
MIRNA = Modality(
    "mirna", "miRNA expression (miRNA-seq)", ("hsa-mir", "hsa-let", "hsa-miR"), "miRNA_ID",
    fixed.MIRNA_METRICS, "reads_per_million_miRNA_mapped", fixed.MIRNA_FILE_SUFFIXES,
    "miRNA Expression Quantification", "BCGSC miRNA Profiling",
)
MODALITIES = {m.id: m for m in (RNASEQ, MIRNA)}


def get_modality(modality: str) -> Modality:
    if modality not in MODALITIES:
        raise KeyError(f"unknown modality {modality!r}; known: {sorted(MODALITIES)}")
    return MODALITIES[modality]


def with_modality(features: DataFrame, feature: str = "feature_id",
                  modalities: Sequence[Modality] = tuple(MODALITIES.values())) -> DataFrame:
    kind = F.lit(None).cast("string")
    for m in reversed(modalities):
        kind = F.when(m.is_feature(F.col(feature)), m.id).otherwise(kind)
    return features.withColumn("modality", kind)


def modality_counts(features: DataFrame, feature: str = "feature_id",
                    modalities: Sequence[Modality] = tuple(MODALITIES.values())) -> DataFrame:
    """Distinct features per modality and whether it is the one with most matches."""
    one = features.select(feature).distinct()
    counts = with_modality(one, feature, modalities).where("modality is not null").groupBy(
        "modality").agg(F.count("*").alias("n_features"))
    rank = F.array_position(F.array(*[F.lit(m.id) for m in modalities]), F.col("modality"))
    best = counts.agg(F.min_by("modality", F.struct(-F.col("n_features"), rank))).scalar()
    return counts.withColumn("detected", F.col("modality") == best)


def detect_modality(features: DataFrame, feature: str = "feature_id") -> Modality | None:
    row = modality_counts(features, feature).where("detected").first()
    return MODALITIES[row["modality"]] if row else None

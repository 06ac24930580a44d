"""Train and test tables without leakage, and reproducibility manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.functions.numbers import finite, log2p1_clipped
from cohortmill.operators.dedup import deepest_sample_per_case
from cohortmill.operators.matrix import feature_statistics, top_by_variance, z_scores
from cohortmill.operators.ranges import RANGE, running_sums
from cohortmill.session import broadcast_if_small, materialize, range_count, written

HASH_DIGITS = 12  # 48 bits, exact in a double

def fit_notes(report: dict, selected: int) -> list[str]:
    """Codes for what the measured tables ask of a model."""
    notes = ["folds_by_case", "outcome_is_censored"]
    if selected > report["n_train"]:
        notes.append("more_features_than_training_rows")
    return notes


def sample_totals(expression: DataFrame, sample: str = "sample_id",
                  value: str = "value") -> DataFrame:
    return expression.groupBy(sample).agg(
        F.sum(F.coalesce(finite(F.col(value)), F.lit(0.0))).alias("total"))


def one_sample_per_case(cohort: DataFrame, expression: DataFrame, sample: str = "sample_id",
                        case: str = "case_id") -> DataFrame:
    """Cohort rows of the deepest sample of each case."""
    totals = cohort.select(sample, case).join(sample_totals(expression, sample), sample)
    kept = deepest_sample_per_case(totals, case, sample)
    return cohort.join(kept.select(sample), sample, "left_semi")


def split_key(case: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), case.cast("string")).cast("binary"))


def case_split(cohort: DataFrame, test_share: float = 0.2, seed: int = 42,
               case: str = "case_id", event: str = "event") -> DataFrame:
    """Cases with is_test: within each event stratum the first share by hash goes to test.

    A case belongs to one side with all its samples. Ranks come from hash ranges, so no
    stratum is sorted by one task.
    """
    cases = cohort.groupBy(case).agg(
        F.coalesce(F.max(F.col(event).cast("int")), F.lit(0)).alias("stratum"))
    key = split_key(F.col(case), seed)
    place = F.conv(F.substring(key, 1, HASH_DIGITS), 16, 10).cast("double")
    ranges = range_count(cohort)
    hashed = cases.withColumns({"__key": key, "__place": place}).withColumns({
        RANGE: F.floor(F.col("__place") / F.lit(float(16 ** HASH_DIGITS)) * ranges).cast("int"),
        "__one": F.lit(1).cast("bigint"),
    })
    ranked = running_sums(hashed, ["stratum"], ["__place", "__key", case], {"rank": "__one"})
    quota = cases.groupBy("stratum").agg(
        F.bround(F.count("*") * F.lit(test_share), 0).cast("bigint").alias("n_test"))
    return ranked.join(F.broadcast(quota), "stratum").select(  # two strata
        case, "stratum", (F.col("rank") <= F.col("n_test")).alias("is_test"))


def split_rows(cohort: DataFrame, split: DataFrame, case: str = "case_id") -> DataFrame:
    return cohort.join(split.select(case, "is_test"), case)


def train_statistics(expression: DataFrame, train: DataFrame, sample: str = "sample_id",
                     feature: str = "feature_id", value: str = "value") -> DataFrame:
    """log2 statistics per feature over the train samples only."""
    samples = broadcast_if_small(train.select(sample))
    cells = expression.join(samples, sample, "left_semi")
    return feature_statistics(cells, feature, value, log2p1_clipped)


def train_features(expression: DataFrame, train: DataFrame, top_k: int = 2000,
                   sample: str = "sample_id", feature: str = "feature_id",
                   value: str = "value") -> DataFrame:
    """Features with the largest log2 variance among train samples; constant ones dropped."""
    stats = train_statistics(expression, train, sample, feature, value)
    return top_by_variance(stats, max(top_k, 1), feature, drop_constant=True)


def scaled_cells(expression: DataFrame, rows: DataFrame, selected: DataFrame,
                 standardize: bool = True, sample: str = "sample_id",
                 feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Long X: transformed cells of the selected features with is_test.

    ``selected`` holds the train statistics; both sides are scaled with them.
    """
    # few features are selected, so the samples are joined to what is left
    if standardize:
        cells = z_scores(expression, selected, feature, value, log2p1_clipped)
    else:
        ids = broadcast_if_small(selected.select(feature))
        cells = expression.join(ids, feature, "left_semi").withColumn(
            "z", log2p1_clipped(F.col(value)))
    sides = broadcast_if_small(rows.select(sample, "is_test"))
    return cells.join(sides, sample).select(sample, feature, "is_test", F.col("z").alias("x"))


def split_report(rows: DataFrame, case: str = "case_id", event: str = "event") -> DataFrame:
    """One row: sizes, event rates and cases found on both sides (leakage)."""
    happened = F.coalesce(F.col(event).cast("int"), F.lit(0))
    test = F.col("is_test")
    per_case = rows.groupBy(case).agg(
        F.count_if(~test).alias("train"), F.count_if(test).alias("test"),
        F.sum(F.when(~test, happened).otherwise(0)).alias("train_events"),
        F.sum(F.when(test, happened).otherwise(0)).alias("test_events"),
    )
    totals = per_case.agg(
        F.sum("train").alias("n_train"), F.sum("test").alias("n_test"),
        F.round(F.sum("train_events") / F.nullif(F.sum("train"), F.lit(0)), 3)
        .alias("event_rate_train"),
        F.round(F.sum("test_events") / F.nullif(F.sum("test"), F.lit(0)), 3)
        .alias("event_rate_test"),
        F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("shared_cases"),
    )
    return totals.withColumn("no_leakage", F.col("shared_cases") == 0)


@dataclass
class Export:
    """Long X with the selected features, y with is_test, and the manifest."""

    cells: DataFrame
    labels: DataFrame
    selected: DataFrame
    manifest: dict

    def feature_names(self) -> list:
        """At most top_k names, in order."""
        return [r[0] for r in self.selected.select(self.selected.columns[0])
                .orderBy(self.selected.columns[0]).collect()]

    def x(self, test: bool, sample: str = "sample_id", feature: str = "feature_id") -> DataFrame:
        side = self.cells.where(F.col("is_test") == test)
        return side.groupBy(sample).pivot(feature, self.feature_names()).agg(F.first("x"))

    def y(self, test: bool) -> DataFrame:
        return self.labels.where(F.col("is_test") == test).drop("is_test")


def prepare_export(cohort: DataFrame, expression: DataFrame, top_k: int = 2000,
                   test_share: float = 0.2, seed: int = 42, one_per_case: bool = True,
                   standardize: bool = True) -> Export:
    """Deduplicate, split by case, select and scale on train only, and describe it all."""
    n_before = cohort.count()
    rows = one_sample_per_case(cohort, expression) if one_per_case else cohort
    split = materialize(case_split(rows, test_share, seed))
    rows = materialize(split_rows(rows, split))
    train = rows.where(~F.col("is_test"))
    report = split_report(rows).first().asDict()
    if not report["n_train"] or not report["n_test"]:
        raise ValueError("train or test is empty; change the share or the seed")
    dictionary = expression.select("feature_id").distinct().count()
    if not dictionary:
        raise ValueError("the matrix has no features")
    stats = materialize(train_statistics(expression, train))
    selected = materialize(top_by_variance(stats, max(top_k, 1), "feature_id", True))
    labels = rows.select(*[c for c in fixed.LABEL_COLUMNS if c in rows.columns], "is_test")
    varying, kept = stats.where("variance > 0").count(), selected.count()
    manifest = {
        "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "rows": {"read": n_before, "kept": report["n_train"] + report["n_test"],
                 "deepest_per_case": one_per_case},
        "features": {"read": dictionary, "constant": dictionary - varying, "kept": kept,
                     "chosen_by": "train variance"},
        "values": {"log2_of_x_plus_1": True, "scaled_by_train": bool(standardize)},
        "split": {"by": "hash of case within event", "test_share": test_share, "seed": seed, **report},
        "notes": fit_notes(report, kept),
    }
    # read by both sides; the matrix is scanned once for it
    cells = written(scaled_cells(expression, rows, selected, standardize), "sample_id")
    return Export(cells, labels, selected, manifest)


# ---- reproducibility manifest -------------------------------------------------------

def content_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and a digest that does not depend on row order or partitioning.

    Each row is hashed; the hashes are added up in four slices, which merge in any order.
    """
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    row_hash = F.sha2(text, 256)
    slices = [F.conv(F.substring(row_hash, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
              for i in range(4)]
    sums = df.agg(F.count("*").alias("n_rows"), *[F.sum(s).alias(f"s{i}") for i, s in
                                                  enumerate(slices)])
    joined = F.concat_ws("-", F.col("n_rows").cast("string"),
                         *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("n_rows", F.sha2(joined, 256).alias("content_hash"))


def matrix_manifest(expression: DataFrame, metric: str, sources: DataFrame | None = None,
                    sample: str = "sample_id", feature: str = "feature_id",
                    value: str = "value") -> DataFrame:
    """One row: counts, metric and digests of the cells, the sample ids and the source files."""
    cells = content_digest(expression, [feature, sample, value])
    ids = content_digest(expression.select(sample).distinct(), [sample])
    features = expression.agg(F.count_distinct(feature)).scalar()
    out = cells.select(
        F.lit(metric).alias("metric"),
        ids.select("n_rows").scalar().alias("n_samples"), features.alias("n_features"),
        F.col("n_rows").alias("n_cells"),
        ids.select("content_hash").scalar().alias("samples_hash"), "content_hash",
    )
    if sources is not None:
        files = content_digest(sources.distinct(), sources.columns)
        out = out.withColumns({
            "n_sources": files.select("n_rows").scalar(),
            "sources_hash": files.select("content_hash").scalar(),
        })
    return out


# ---- manifests that can be compared -------------------------------------------------

def feature_digests(expression: DataFrame, sample: str = "sample_id", feature: str = "feature_id",
                    value: str = "value") -> DataFrame:
    """(feature, n_cells, digest) per feature, whatever the order of its cells. A table of one row
    per feature, by which two builds are compared without reading their cells."""
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (sample, value)])
    row_hash = F.sha2(text, 256)
    slices = [F.conv(F.substring(row_hash, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"__h{i}") for i in range(4)]
    # a slice is below 2^32, so sums of up to two thousand million cells fit a long
    sums = expression.select(F.col(feature).alias("feature"), *slices).groupBy("feature").agg(
        F.count("*").alias("n_cells"), *[F.sum(f"__h{i}").alias(f"__s{i}") for i in range(4)])
    joined = F.concat_ws("-", F.col("n_cells").cast("string"), *[F.col(f"__s{i}").cast("string") for i in range(4)])
    return sums.select("feature", "n_cells", F.sha2(joined, 256).alias("digest"))


def manifest_tables(expression: DataFrame, metric: str, sources: DataFrame | None = None,
                    sample: str = "sample_id", feature: str = "feature_id", value: str = "value") -> dict[str, DataFrame]:
    """A manifest as tables: ``features`` (digests per feature), ``samples`` and ``sources`` (the ids and
    files themselves), and ``manifest``, one row with their counts and digests."""
    tables = {
        "features": materialize(feature_digests(expression, sample, feature, value)),
        "samples": materialize(expression.select(sample).distinct()),
    }
    if sources is not None:
        tables["sources"] = materialize(sources.distinct())
    cells = tables["features"].agg(F.sum("n_cells")).scalar()
    row = content_digest(tables["features"], ["feature", "n_cells", "digest"]).select(
        F.lit(metric).alias("metric"), F.col("n_rows").alias("n_features"), cells.alias("n_cells"),
        F.col("content_hash").alias("features_hash"))
    for name in ("samples", "sources"):
        if name in tables:
            digest = content_digest(tables[name], tables[name].columns)
            row = row.withColumns({f"n_{name}": digest.select("n_rows").scalar(),
                                   f"{name}_hash": digest.select("content_hash").scalar()})
    return {"manifest": row, **tables}


def compare_manifests(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """(table, id, status) of what differs between two manifests: ``only_left``, ``only_right`` or, for
    features, ``changed``. Tables whose digests agree are not read, and cells never are."""
    a, b = (side["manifest"].first().asDict() for side in (left, right))
    found = []
    for name in ("features", "samples", "sources"):
        if name not in left or name not in right or a[f"{name}_hash"] == b[f"{name}_hash"]:
            continue
        keys = ["feature"] if name == "features" else list(left[name].columns)
        content = F.col("digest") if name == "features" else F.lit("")
        sides = [side[name].select(F.concat_ws("\t", *[F.col(k).cast("string") for k in keys]).alias("id"), content.alias(which))
                 for side, which in ((left, "l"), (right, "r"))]
        status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(
            F.col("l") != F.col("r"), "changed")
        found.append(sides[0].join(sides[1], "id", "full").select(F.lit(name).alias("table"), "id", status.alias("status"))
                     .where("status is not null"))
    if not found:
        return left["manifest"].sparkSession.createDataFrame([], "table string, id string, status string")
    return reduce(DataFrame.unionByName, found)


def changed_cells(left: DataFrame, right: DataFrame, differences: DataFrame, sample: str = "sample_id",
                  feature: str = "feature_id", value: str = "value") -> DataFrame:
    """(feature, sample, before, after) of the cells that differ, reading the changed features alone."""
    changed = broadcast_if_small(differences.where("table = 'features' and status = 'changed'").select(F.col("id").alias("__id")))
    sides = [side.join(changed, F.col(feature).cast("string") == F.col("__id"), "left_semi").select(
        feature, sample, F.struct(value).alias(name)) for side, name in ((left, "before"), (right, "after"))]
    return sides[0].join(sides[1], [feature, sample], "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(
        feature, sample, F.col(f"before.{value}").alias("before"), F.col(f"after.{value}").alias("after"))

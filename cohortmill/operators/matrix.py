"""Feature-by-sample data in long form: construction, checks and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.functions.identifiers import file_stem, site_code
from cohortmill.functions.numbers import finite, log2p1, percent, ratio
from cohortmill.operators import aggregates
from cohortmill.operators.dedup import chosen_files
from cohortmill.operators.filters import RNASEQ, Modality, biotype_filter, resolve_metric
from cohortmill.operators.joins import files_to_samples, stem_map, unmapped_files
from cohortmill.operators.ranges import average_rank, ordinal_rank, quantiles
from cohortmill.operators.survival import named_features, panel_cells
from cohortmill.session import broadcast_if_small, materialize, written


# ---- construction -----------------------------------------------------------------

def file_totals(cells: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    return cells.groupBy(file).agg(F.sum(value).alias("total"))


def build_matrix(quantification: DataFrame, sheet: DataFrame, metric: str | None = None,
                 duplicate_strategy: str = "fail", biotype: str | None = None,
                 features: DataFrame | None = None, modality: Modality = RNASEQ,
                 file: str = "file_name", feature: str | None = None,
                 complete: bool = True) -> DataFrame:
    """Long matrix (sample_id, feature_id, value) from per-file quantification rows.

    Files without a sheet row are an error. Of several files of a sample one is chosen.
    The biotype filter runs before the cells are shuffled; without ``features`` the biotypes
    are those in the files. Unless ``complete`` is off, samples with different features,
    repeated features or null cells are an error.
    """
    feature = feature or modality.feature_column
    metric = resolve_metric(metric or modality.default_metric, modality.metrics)
    cells = quantification.select(
        F.col(file).alias("file"), F.col(feature).alias("feature_id"),
        F.col(metric).alias("value"),
    )
    totals = materialize(file_totals(cells).withColumn(
        "stem", file_stem(F.col("file"), modality.file_suffixes)
    ))
    stems = stem_map(sheet, modality.file_suffixes)
    lost = [r[0] for r in unmapped_files(totals, stems).limit(5).collect()]
    if lost:
        raise ValueError(f"files without a sample sheet row: {lost}")
    chosen = chosen_files(files_to_samples(totals, stems), duplicate_strategy)
    if biotype is not None:
        if features is None:
            features = quantification.select(
                F.col(feature).alias("feature_id"), "gene_type").distinct()
        cells = biotype_filter(cells, features, biotype)
    picked = broadcast_if_small(chosen.select("file", "sample_id"))
    matrix = cells.join(picked, "file").select("sample_id", "feature_id", "value")
    return assert_matrix(matrix) if complete else matrix


def stored_matrix(expression: DataFrame, feature: str = "feature_id") -> DataFrame:
    """The matrix as a parquet table kept feature by feature, for repeated feature statistics."""
    return written(expression, feature)


def matrix_checks(expression: DataFrame, sample: str = "sample_id", feature: str = "feature_id",
                  value: str = "value") -> DataFrame:
    """Per sample: features, repeated features, null and non-finite cells, and whether the
    sample covers the whole feature dictionary.

    A sample whose feature count and two hash sums equal those of the dictionary is complete;
    only the cells of other samples are shuffled and counted per feature.
    """
    x = F.col(value).cast("double")
    marks = [F.sum(F.xxhash64(feature, F.lit(s)).cast("decimal(38,0)")).alias(f"h{s}")
             for s in (1, 2)]
    per_sample = materialize(expression.groupBy(sample).agg(
        F.count("*").alias("n"), *marks, F.count_if(x.isNull()).alias("n_null"),
        F.count_if(x.isNotNull() & finite(x).isNull()).alias("n_non_finite"),
    ))
    size, h1, h2 = expression.select(feature).distinct().agg(F.count("*"), *marks).first()
    same = (F.col("n") == size) & (F.col("h1") == F.lit(h1)) & (F.col("h2") == F.lit(h2))
    whole = per_sample.where(same).select(
        sample, F.col("n").alias("n_features"), F.lit(0).cast("bigint").alias("n_repeated"),
        F.lit(True).alias("complete"))
    others = broadcast_if_small(per_sample.where(~same).select(sample))
    counted = expression.select(sample, feature).join(others, sample, "left_semi").groupBy(
        sample, feature).agg(F.count("*").alias("n")).groupBy(sample).agg(
        F.count("*").alias("n_features"), F.sum(F.col("n") - 1).alias("n_repeated")
    ).withColumn("complete", F.col("n_features") == F.lit(size))
    return whole.unionByName(counted).join(
        per_sample.select(sample, "n_null", "n_non_finite"), sample)


def assert_matrix(expression: DataFrame, **columns) -> DataFrame:
    """The matrix itself when every sample has every feature once and no cell is null."""
    bad = matrix_checks(expression, **columns).where(
        ~F.col("complete") | (F.col("n_repeated") > 0) | (F.col("n_null") > 0)
    )
    rows = [r.asDict() for r in bad.limit(5).collect()]
    if rows:
        raise ValueError(f"matrix is not complete: {rows}")
    return expression


def widen(expression: DataFrame, names: Sequence, by: str = "sample_id",
          across: str = "feature_id", value: str = "value") -> DataFrame:
    """One column per listed name. The list is given, so no distinct pass is needed."""
    return expression.groupBy(by).pivot(across, list(names)).agg(F.first(value))


def transpose(wide: DataFrame, columns: Sequence[str], rows: Sequence, by: str,
              to: str) -> DataFrame:
    """A small wide table with rows and columns exchanged."""
    long = wide.unpivot(by, list(columns), to, "value")
    return widen(long, rows, to, by)


# ---- value distribution -----------------------------------------------------------

def value_distribution(expression: DataFrame, value: str = "value", sample: str = "sample_id",
                       feature: str = "feature_id") -> DataFrame:
    """One row: quartiles and largest finite value, share of zeros, median depth, metric."""
    cells = expression.withColumn("__x", finite(F.col(value)))
    counts = cells.agg(
        F.max("__x").alias("max"),
        percent(F.count_if(F.col(value) == 0), F.count("*")).alias("zero_pct"),
        all_whole(F.col("__x")).alias("__whole"),
    )
    points = quantiles(cells, (), "__x", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    depth = quantiles(
        aggregates.sample_depth(cells, sample, "__x"), (), "depth", {"median_depth": 0.5}
    )
    return counts.withColumns({
        "__q": points.select(F.struct("*")).scalar(),
        "median_depth": depth.scalar(),
    }).select(
        "max", "zero_pct", "__q.*", "median_depth",
        metric_name(F.col("median_depth"), F.col("__whole")).alias("metric"),
    )


def all_whole(x: Column) -> Column:
    """Aggregate: whether all finite values are whole numbers; false without any."""
    near = F.abs(x - F.rint(x)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(x))
    return F.coalesce(F.bool_and(near), F.lit(False))


def whole_valued(expression: DataFrame, value: str = "value") -> DataFrame:
    """Whether all finite values are whole numbers."""
    return expression.agg(all_whole(finite(F.col(value))).alias("whole"))


def metric_name(median_depth: Column, whole: Column) -> Column:
    return (
        F.when(median_depth.between(9.0e5, 1.1e6), "TPM")
        .when(whole, "counts").otherwise("FPKM/other")
    )


def depth_outliers(depths: DataFrame, share: float = 0.05) -> DataFrame:
    """Samples whose depth is more than ``share`` away from the median depth."""
    median = quantiles(depths, (), "depth", {"m": 0.5}).scalar()
    marked = depths.withColumn("__m", median).withColumn(
        "deviation", F.col("depth") / F.col("__m") - 1
    )
    return marked.where(F.abs("deviation") > share).drop("__m")


def histogram(expression: DataFrame, bins: int = 80, value: str = "value",
              keys: Sequence[str] = (), transform=log2p1, cap: float | None = None) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value, per group.

    The last bin includes its upper edge. ``cap`` leaves out larger values.
    """
    keys = list(keys)
    cells = expression.select(*keys, transform(F.col(value)).alias("__x"))
    if cap is not None:
        cells = cells.where(F.col("__x") <= cap)
    edges = cells.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    if keys:
        placed = cells.join(broadcast_if_small(edges), keys)
    else:
        placed = cells.withColumn("__e", edges.select(F.struct("*")).scalar()).select(
            "*", "__e.*")
    width = (F.col("__hi") - F.col("__lo")) / bins
    raw = F.floor((F.col("__x") - F.col("__lo")) / F.nullif(width, F.lit(0.0)))
    bin_no = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    return placed.groupBy(*keys, bin_no.alias("bin")).agg(
        F.count("*").alias("n"),
        F.min(F.col("__lo") + bin_no * width).alias("bin_from"),
        F.min(F.col("__lo") + (bin_no + 1) * width).alias("bin_to"),
    )


def capped_share(expression: DataFrame, caps: Sequence[float] = (50.0, 5.0),
                 value: str = "value") -> DataFrame:
    """Percent of cells at or below each cap."""
    counts = expression.agg(F.count(value).alias("n"), *[
        F.count_if(F.col(value) <= c).alias(f"c{i}") for i, c in enumerate(caps)
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(float(c)).alias("cap"), F.col(f"c{i}").alias("n_shown"),
                 percent(F.col(f"c{i}"), F.col("n")).alias("pct_shown"))
        for i, c in enumerate(caps)
    ])))


# ---- feature statistics -----------------------------------------------------------

def feature_statistics(expression: DataFrame, feature: str = "feature_id",
                       value: str = "value", transform=log2p1) -> DataFrame:
    """Mean, population variance and sd of the transformed values per feature."""
    x = transform(F.col(value))
    return expression.groupBy(feature).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"),
        F.stddev_pop(x).alias("sd"),
    )


def variance_thresholds(stats: DataFrame,
                        thresholds: Sequence[float] = (0.1, 0.5, 1.0, 2.0)) -> DataFrame:
    counts = stats.agg(F.count("*").alias("n"), *[
        F.count_if(F.col("variance") > t).alias(f"c{i}") for i, t in enumerate(thresholds)
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("n_above"),
                 percent(F.col(f"c{i}"), F.col("n")).alias("pct_above"))
        for i, t in enumerate(thresholds)
    ])))


def top_by_variance(stats: DataFrame, k: int, feature: str = "feature_id",
                    drop_constant: bool = False) -> DataFrame:
    """The k features with the largest variance; ties by feature id."""
    rows = stats.where(F.col("variance") > 0) if drop_constant else stats
    return rows.orderBy(F.col("variance").desc(), feature).limit(k)


def z_scores(expression: DataFrame, stats: DataFrame, feature: str = "feature_id",
             value: str = "value", transform=log2p1) -> DataFrame:
    """Cells with ``z``; a feature without spread is only centred."""
    scale = broadcast_if_small(stats.select(
        feature, "mean", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd")
    ))
    z = (transform(F.col(value)) - F.col("mean")) / F.col("sd")
    return expression.join(scale, feature).withColumn("z", z).drop("mean", "sd")


def eta_squared(rows: DataFrame, value: str, group: str, keys: Sequence[str] = (),
                out: str = "eta_squared") -> DataFrame:
    """Share of the variance of a number explained by a grouping; null below three values
    or without spread."""
    x = finite(F.col(value))
    per_group = rows.withColumn("__x", x).where("__x is not null").groupBy(*keys, group).agg(
        F.count("*").alias("n"), F.avg("__x").alias("m"), F.var_pop("__x").alias("v"),
    )
    n, m = F.col("n"), F.col("m")
    if keys:
        groups = Window.partitionBy(*keys)  # one row per group
        grand = F.sum(n * m).over(groups) / F.sum(n).over(groups)
    else:
        grand = per_group.agg(F.sum(n * m) / F.sum(n)).scalar()
    parts = per_group.withColumn("gap", m - grand).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(n * F.col("v")).alias("within"),
        F.sum(n * F.col("gap") * F.col("gap")).alias("between"),
    )
    total = F.col("within") + F.col("between")
    share = F.when((F.col("n") >= 3) & (total > 0), F.col("between") / total)
    return parts.select(*keys, F.col("n"), share.alias(out))


def marker_summary(expression: DataFrame, markers: Mapping[str, str] = fixed.MARKER_GENES,
                   feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Median and median log2 of named features; absent ones keep a row."""
    names = named_features(expression, markers, feature)
    cells = panel_cells(expression, names.dropDuplicates([feature]), feature).withColumn(
        "__log", log2p1(F.col(value)))
    raw = quantiles(cells, [feature], value, {"median": 0.5})
    logs = quantiles(cells, [feature], "__log", {"median_log2": 0.5})
    return (
        names.join(raw, feature, "left").join(logs, feature, "left")
        .select("symbol", "base", feature, F.col(feature).isNotNull().alias("found"),
                "median", "median_log2")
    )


def marker_boxes(expression: DataFrame, markers: Mapping[str, str], group: str,
                 feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Box statistics of log2 values per marker and group."""
    names = named_features(expression, markers, feature)
    cells = panel_cells(expression, names, feature).withColumn("__log", log2p1(F.col(value)))
    return quantiles(cells, ["symbol", group], "__log",
                     {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, count="n")


def metric_comparison(counts: DataFrame, other: DataFrame, names: DataFrame, first, second,
                      feature: str = "feature_id", name: str = "feature_name",
                      sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Two samples under two metrics for the listed features, with their ratios."""
    def two(cells: DataFrame, label: str) -> DataFrame:
        return cells.where(F.col(sample).isin(first, second)).groupBy(feature).agg(
            F.max(F.when(F.col(sample) == first, F.col(value))).alias(f"{label}_first"),
            F.max(F.when(F.col(sample) == second, F.col(value))).alias(f"{label}_second"),
        )

    both = two(counts, "counts").join(two(other, "other"), feature)
    return names.select(feature, name).join(both, feature).withColumns({
        "ratio_counts": ratio(F.col("counts_first"), F.col("counts_second")),
        "ratio_other": ratio(F.col("other_first"), F.col("other_second")),
    })


def biotype_distribution(features: DataFrame, biotype: str = "gene_type") -> DataFrame:
    return aggregates.group_shares(features, biotype).select(biotype, "n", "pct")


def site_distribution(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Samples per tissue source site, read from the barcode."""
    one = samples.select(sample).distinct().withColumn("site", site_code(F.col(sample)))
    return aggregates.group_shares(one, "site")


def feature_ranks(expression: DataFrame, feature: str = "feature_id",
                  sample: str = "sample_id", value: str = "value", ties: str = "ordinal") -> DataFrame:
    """Rank of each sample per feature: ordinal (ties by sample id), or average over ties."""
    if ties not in ("ordinal", "average"):
        raise ValueError(f"unknown ties {ties!r}; use ordinal or average")
    if ties == "average":
        return average_rank(expression.select(feature, sample, value), [feature], value, sample)
    return ordinal_rank(expression.select(feature, sample, value), [feature], [value, sample])

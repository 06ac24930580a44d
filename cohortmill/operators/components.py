"""Principal components and rank correlation through MLlib."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.functions.numbers import log2p1, log2p1_clipped
from cohortmill.operators.matrix import (
    feature_ranks, feature_statistics, top_by_variance, z_scores,
)


def numbered(selected: DataFrame, feature: str = "feature_id") -> DataFrame:
    """The selected features (a few thousand at most) numbered from 0 by id."""
    order = Window.orderBy(feature)
    return selected.select(feature, (F.row_number().over(order) - 1).alias("position"))


def sample_vectors(cells: DataFrame, positions: DataFrame, value: str,
                   sample: str = "sample_id", feature: str = "feature_id") -> DataFrame:
    """One vector per sample in the order of ``position``; as long as the selection.

    ``positions`` holds the selected features, a few thousand at most. A sample that lacks one of
    them, or has one twice, is an error: its later values would slip into wrong positions.
    """
    placed = cells.join(F.broadcast(positions), feature).groupBy(sample).agg(
        F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("x")))).alias("c")
    )
    size = positions.count()
    in_place = F.transform("c", lambda c: c["position"]) == F.sequence(F.lit(0), F.lit(size - 1))
    checked = F.when(in_place, F.transform("c", lambda c: c["x"])).otherwise(F.raise_error(F.concat(
        F.lit("a sample lacks selected features or repeats one: "), F.col(sample).cast("string"))))
    return placed.select(sample, array_to_vector(checked).alias("features"))


def standardized_vectors(expression: DataFrame, top_n: int = 2000, clipped: bool = False,
                         sample: str = "sample_id", feature: str = "feature_id",
                         value: str = "value", transform=None) -> tuple[DataFrame, int]:
    """Vectors of z-scored log2 values of the most variable features, and their length."""
    transform = transform or (log2p1_clipped if clipped else log2p1)
    stats = feature_statistics(expression, feature, value, transform)
    top = top_by_variance(stats, top_n, feature).persist()
    scaled = z_scores(expression, top, feature, value, transform)
    return sample_vectors(scaled, numbered(top, feature), "z", sample, feature), top.count()


def principal_components(vectors: DataFrame, k: int = 5, sample: str = "sample_id"
                         ) -> tuple[DataFrame, DataFrame]:
    """(percent of variance per component, scores per sample).

    MLlib forms the p x p covariance across the cluster; p is the number of selected features.
    A component's sign is free: here its largest loading is positive, the first one of ties.
    """
    spark = vectors.sparkSession
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(vectors)
    shares = [float(v) * 100.0 for v in model.explainedVariance.toArray()]
    table, running = [], 0.0
    for i, share in enumerate(shares, 1):
        running += share
        table.append((i, share, running))
    variance = spark.createDataFrame(table, "pc int, var_pct double, cum_pct double")
    loadings = model.pc.toArray()
    # rounded, so that loadings equal but for the last digits count as ties
    largest = np.argmax(np.round(np.abs(loadings), 9), axis=0)
    signs = [1.0 if loadings[row, i] >= 0 else -1.0 for i, row in enumerate(largest)]
    arrays = model.transform(vectors).select(sample, vector_to_array("scores").alias("s"))
    scores = arrays.select(sample, *[
        (F.col("s")[i] * F.lit(sign)).alias(f"pc{i + 1}") for i, sign in enumerate(signs)])
    return variance, scores


def pca(expression: DataFrame, k: int = 5, top_n: int = 2000, **columns
        ) -> tuple[DataFrame, DataFrame]:
    vectors, p = standardized_vectors(expression, top_n, **columns)
    vectors = vectors.persist()
    return principal_components(vectors, min(k, p), columns.get("sample", "sample_id"))


def component_overlay(scores: DataFrame, metadata: DataFrame, sample: str = "sample_id",
                      site: str = "site", top_sites: int = 8) -> DataFrame:
    """Scores with metadata; sites beyond the largest few are called "other"."""
    largest = metadata.groupBy(site).agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), site).limit(top_sites).select(site, F.lit(True).alias("__top"))
    marked = metadata.join(F.broadcast(largest), site, "left")  # at most top_sites rows
    return scores.join(marked, sample).withColumn(
        "site_group", F.when(F.col("__top"), F.col(site).cast("string")).otherwise("other")
    ).drop("__top")


def rank_correlation(expression: DataFrame, top_n: int = 50, feature: str = "feature_id",
                     sample: str = "sample_id", value: str = "value",
                     transform=log2p1, ties: str = "ordinal") -> DataFrame:
    """Spearman correlation of the most variable features, long form; ``ties`` as in ``feature_ranks``."""
    stats = feature_statistics(expression, feature, value, transform)
    top = numbered(top_by_variance(stats, top_n, feature), feature).persist()
    chosen = expression.join(F.broadcast(top.select(feature)), feature, "left_semi")  # top_n ids
    ranks = feature_ranks(chosen, feature, sample, value, ties)
    vectors = sample_vectors(ranks, top, "rank", sample, feature)
    # top_n x top_n numbers, a few thousand
    matrix = Correlation.corr(vectors, "features", "pearson").first()[0].toArray()
    cells = expression.sparkSession.createDataFrame(
        [(i, j, float(rho)) for i, row in enumerate(matrix) for j, rho in enumerate(row)],
        "i int, j int, rho double",
    )
    a = top.select(F.col("position").alias("i"), F.col(feature).alias("feature_a"))
    b = top.select(F.col("position").alias("j"), F.col(feature).alias("feature_b"))
    return cells.join(a, "i").join(b, "j").select("feature_a", "feature_b", "rho")


def covariance_cells(expression: DataFrame, top_n: int, feature: str = "feature_id",
                     sample: str = "sample_id", value: str = "value",
                     transform=log2p1) -> DataFrame:
    """Covariance (population) of the standardized top features, long form."""
    stats = feature_statistics(expression, feature, value, transform)
    top = top_by_variance(stats, top_n, feature).persist()
    order = numbered(top, feature).persist()
    scaled = z_scores(expression, top, feature, value, transform)
    vectors = sample_vectors(scaled, order, "z", sample, feature)
    n = vectors.count()
    # z-scores have unit population variance, so correlation is covariance; constant rows are 0
    matrix = Correlation.corr(vectors, "features", "pearson").first()[0].toArray()
    constant = {r[0] for r in top.where("sd = 0").join(order, feature).select("position").collect()}
    cells = expression.sparkSession.createDataFrame(
        [(i, j, 0.0 if i in constant or j in constant or n == 0 else float(c))
         for i, row in enumerate(matrix) for j, c in enumerate(row)],
        "i int, j int, covariance double",
    )
    a = order.select(F.col("position").alias("i"), F.col(feature).alias("feature_a"))
    b = order.select(F.col("position").alias("j"), F.col(feature).alias("feature_b"))
    return cells.join(a, "i").join(b, "j").select("feature_a", "feature_b", "covariance")

"""Ordered operators against numpy, with a group that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortmill.operators.ranges import RANGE, average_rank, ordinal_rank, quantiles, with_order_range

PROBS = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.lognormal(0, 3, 4000), 3)})
    # one value fills a third of the hot group; another group is all ties
    hot.loc[:1300, "v"] = 1.5
    rest = pd.DataFrame({"g": rng.choice(list("abc"), 600), "v": rng.normal(100, 0.01, 600)})
    same = pd.DataFrame({"g": "same", "v": [7.0] * 50})
    one = pd.DataFrame({"g": ["one"], "v": [-3.5]})
    pdf = pd.concat([hot, rest, same, one], ignore_index=True)
    pdf["id"] = rng.permutation(len(pdf))
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", PROBS, count="n").collect()}
    assert set(got) == set(pdf.g)
    for g, values in pdf.groupby("g").v:
        assert got[g]["n"] == len(values)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12), (g, name)


def test_quantiles_without_group_and_weighted(spark, skewed):
    pdf, df = skewed
    row = quantiles(df, (), "v", PROBS).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.percentile(pdf.v, 100 * p), rel=1e-12)
    counted = df.groupBy("g", "v").count()
    again = quantiles(counted, (), "v", PROBS, weight="count").first()
    assert tuple(row) == tuple(again)


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert quantiles(df, (), "v", {"m": 0.5}).first()[0] == 2.0


def test_quantiles_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 1.5, "a": 5.0}


def test_ordinal_rank_matches_pandas(skewed):
    pdf, df = skewed
    got = ordinal_rank(df, ["g"], ["v", "id"]).toPandas().set_index("id")["rank"]
    ordered = pdf.sort_values(["v", "id"])
    want = dict(zip(ordered["id"], ordered.groupby("g").cumcount() + 1))
    assert got.to_dict() == want


@pytest.mark.parametrize("order", [["v", "id"], ["text"]])
def test_tied_values_and_long_common_prefixes_are_split(spark, order):
    rows = spark.range(20_000).select(
        F.lit("gene").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("v"),
        "id", F.concat(F.lit("the same twenty bytes "), F.lpad("id", 6, "0")).alias("text"))
    sizes = [r["count"] for r in with_order_range(rows, ["g"], order).groupBy(RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    ranks = ordinal_rank(rows, ["g"], order).orderBy(*order).select("rank").toPandas()["rank"]
    assert ranks.tolist() == list(range(1, 20_001))


def test_same_result_for_any_number_of_partitions(spark, skewed):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 8, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = quantiles(df.repartition(n), ["g"], "v", PROBS).collect()
            seen.append(sorted(tuple(r) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 2)), min_size=1, max_size=60))
def test_any_list_has_numpy_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles(df, (), "v", PROBS).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-9, abs=1e-9)


def mid_ranks(pdf):
    return pdf.groupby("g").v.rank(method="average", na_option="top")


def test_average_ranks_match_pandas(spark, skewed):
    pdf, df = skewed
    got = average_rank(df, ["g"], "v", "id").toPandas().set_index("id")["rank"].sort_index()
    want = mid_ranks(pdf).set_axis(pdf.id).sort_index()
    assert np.allclose(got, want)


def test_average_ranks_of_mostly_zeros(spark):
    """Zeros fill nine tenths and go over many ranges; no task holds more than twice the mean."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 20_000, p=[0.8, 0.15, 0.05]),
                        "v": np.where(rng.random(20_000) < 0.9, 0.0, np.round(rng.normal(0, 2, 20_000), 1)), "id": np.arange(20_000)})
    pdf.loc[pdf.id % 997 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    sizes = [r["count"] for r in with_order_range(df, ["g"], ["v", "id"]).groupBy(RANGE).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * np.mean(sizes)
    got = average_rank(df, ["g"], "v", "id").toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(got, mid_ranks(pdf))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([None, -1.0, 0.0, -0.0, 2.5])), max_size=40))
def test_average_ranks_of_any_rows(spark, rows):
    pdf = pd.DataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], columns=["g", "v", "id"])
    df = spark.createDataFrame([tuple(r) for r in [(g, v, i) for i, (g, v) in enumerate(rows)]], "g string, v double, id long")
    got = {r["id"]: r["rank"] for r in average_rank(df, ["g"], "v", "id").collect()}
    pdf["v"] = pdf["v"].astype(float)
    assert got == pytest.approx(dict(zip(pdf.id, mid_ranks(pdf)))) if rows else got == {}


def test_nearest_quantiles(spark, skewed):
    pdf, df = skewed
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", PROBS, nearest=True).collect()}
    for g, values in pdf.groupby("g").v:
        ranked = np.sort(values.to_numpy())
        for name, p in PROBS.items():
            assert got[g][name] == ranked[int(np.floor((len(ranked) - 1) * p + 0.5))]

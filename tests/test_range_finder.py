"""Leading components without a covariance matrix, against the decomposition of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import components as K
from cohortmill.operators import range_finder as RF


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "sample_id long, features array<double>").repartition(parts)


def check(got, x, k):
    variance, scores = got
    z = x - x.mean(axis=0)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    s = np.r_[s, np.zeros(k)][:k]
    shares = [r["var_pct"] for r in variance.orderBy("pc").collect()]
    assert np.allclose(shares, 100 * s ** 2 / max((z ** 2).sum(), 1e-300), atol=1e-6)
    found = scores.toPandas().sort_values("sample_id")[[f"pc{i + 1}" for i in range(k)]].to_numpy()
    for i in range(min(k, len(v))):
        if s[i] > 1e-6 * s[0]:
            sign = 1 if v[i][np.argmax(np.round(np.abs(v[i]), 9))] >= 0 else -1
            assert np.allclose(found[:, i], sign * z @ v[i], atol=1e-4 * s[0]), i


def spread(rng, n, p, lengths):
    """Samples whose components have given lengths, and a mean that is not zero."""
    left = np.linalg.qr(rng.standard_normal((n, len(lengths))))[0]
    right = np.linalg.qr(rng.standard_normal((p, len(lengths))))[0]
    return left * np.array(lengths) @ right.T + rng.standard_normal(p) * 3


@pytest.mark.parametrize("case", ["narrow", "wide", "few samples", "steep", "low rank"])
def test_components_equal_those_of_the_whole(spark, case):
    rng = np.random.default_rng(3)
    x = {"narrow": lambda: rng.standard_normal((60, 9)) * np.arange(1, 10),
         "wide": lambda: spread(rng, 80, 150, [40, 31, 22, 17, 12] + [2.0] * 60),
         "few samples": lambda: rng.standard_normal((4, 90)),
         "steep": lambda: spread(rng, 50, 70, [1e4, 1e2, 1, 1e-2]),
         "low rank": lambda: spread(rng, 50, 60, [5, 3])}[case]()
    check(RF.leading_components(frame(spark, x), 5, oversample=6), x, 5)


def test_twenty_thousand_features(spark):
    rng = np.random.default_rng(4)
    x = spread(rng, 40, 20_000, [90, 70, 50, 30, 20] + [1.5] * 30)
    check(RF.leading_components(frame(spark, x), 3, oversample=8), x, 3)


def test_equal_to_the_covariance_form(spark, dataset):
    vectors, _ = K.standardized_vectors(dataset[1], 30)
    one, two = K.principal_components(vectors, 4), RF.leading_components(vectors, 4, oversample=26)
    a, b = ([tuple(r) for r in v.orderBy("pc").collect()] for v in (one[0], two[0]))
    assert np.allclose(a, b, atol=1e-6)
    a, b = (s.toPandas().set_index("sample_id").sort_index() for s in (one[1], two[1]))
    assert np.allclose(a, b, atol=1e-6)


def test_no_variance_no_rows_and_unequal_lengths(spark):
    same = frame(spark, np.ones((5, 4)))
    variance, scores = RF.leading_components(same, 2)
    assert [r["var_pct"] for r in variance.collect()] == [0.0, 0.0]
    assert scores.where("pc1 <> 0 or pc2 <> 0").count() == 0 and scores.count() == 5
    variance, scores = RF.leading_components(same.limit(0), 2)
    assert scores.count() == 0 and variance.count() == 2
    with pytest.raises(ValueError, match="vectors of"):
        RF.leading_components(same.withColumn("features", F.slice("features", 1, (F.col("sample_id") % 3 + 1).cast("int"))))

import math

import numpy as np
import pytest

from cohortmill.functions.fixed import SIGNATURE_PANEL
from cohortmill.operators import concordance as CI
from cohortmill.operators import cox as C
from tests import reference_math as R


@pytest.fixture(scope="module")
def cohort_rows(spark):
    rng = np.random.default_rng(9)
    n = 150
    x = np.column_stack([rng.normal(60, 10, n), rng.integers(0, 2, n), rng.integers(1, 5, n)]).astype(float)
    risk = 0.03 * (x[:, 0] - 60) + 0.5 * x[:, 2]
    time = np.ceil(rng.exponential(40 / np.exp(risk - risk.mean()))).astype(int)
    event = rng.random(n) < 0.6
    df = spark.createDataFrame(
        [(int(t), bool(e), *map(float, row)) for t, e, row in zip(time, event, x)],
        "time bigint, event boolean, age double, male double, stage double")
    return x, time, event, df.persist()


def test_fit_matches_brute_force(cohort_rows):
    x, time, event, df = cohort_rows
    fit = C.fit_cox(df, ("age", "male", "stage"))
    centred = x - x.mean(axis=0)
    want, cov = R.maximize(lambda b: R.efron(b, centred, time, event), 3)
    assert np.allclose(fit.coefficients, want, atol=1e-6)
    assert np.allclose(np.sqrt(np.diag(fit.covariance)), np.sqrt(np.diag(cov)), rtol=1e-3)
    assert fit.log_likelihood == pytest.approx(R.efron(want, centred, time, event), abs=1e-6)
    assert fit.penalizer == 0.0 and fit.n == 150 and fit.n_events == event.sum()


def test_effects(spark, cohort_rows):
    fit = C.fit_cox(cohort_rows[-1], ("age", "male", "stage"))
    for r, b in zip(C.effect_table(spark, fit).collect(), fit.coefficients, strict=True):
        assert r["hr"] == pytest.approx(math.exp(b))
        assert r["ci_lower"] < r["hr"] < r["ci_upper"]
        assert r["direction"] == ("protective" if b < 0 else "risk")
        assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9)


def test_ridge_matches_penalized_likelihood(cohort_rows):
    x, time, event, df = cohort_rows
    fit = C.fit_cox(df, ("age", "male", "stage"), penalizers=(0.5,))
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / sd
    want, _ = R.maximize(lambda b: R.efron(b, z, time, event) - len(x) * 0.25 * (b @ b), 3)
    assert np.allclose(fit.coefficients, want / sd, atol=1e-6)


def test_collinear_columns_fall_back_to_ridge(cohort_rows):
    df = cohort_rows[-1].withColumn("twice", 2 * cohort_rows[-1]["age"])
    fit = C.fit_cox(df, ("age", "twice", "stage"))
    assert fit.penalizer > 0 and np.isfinite(fit.coefficients).all()


def test_constant_columns_are_dropped(cohort_rows):
    from pyspark.sql import functions as F

    fit = C.fit_cox(cohort_rows[-1].withColumn("same", F.lit(1.0)), ("age", "same"))
    assert fit.covariates == ["age"] and fit.dropped == ["same"]


def test_too_few_rows(cohort_rows):
    with pytest.raises(ValueError, match="too few"):
        C.fit_cox(cohort_rows[-1].limit(10), ("age",))


def test_many_deaths_on_one_day(spark, monkeypatch):
    """A day is cut into runs of tied deaths; the sums must not depend on the run length."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(1, 3)), True, float(rng.normal())) for _ in range(90)]
    df = spark.createDataFrame(rows, "time bigint, event boolean, x0 double")
    want = C.moments(df, 1, (0.3,)).first()
    monkeypatch.setattr(C, "TIES_PER_ROW", 7)
    got = C.moments(df, 1, (0.3,)).first()
    assert tuple(got) == pytest.approx(tuple(want), rel=1e-12)
    x, t = np.array([[r[2]] for r in rows]), np.array([r[0] for r in rows])
    assert got["ll"] == pytest.approx(R.efron(np.array([0.3]), x, t, np.ones(90, bool)))


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_concordance_matches_pairs(spark, digits):
    rng = np.random.default_rng(digits)
    n = 300
    time, event = rng.integers(1, 60, n), rng.random(n) < 0.6
    risk = np.round(rng.normal(size=n), digits)
    df = spark.createDataFrame([(int(t), bool(e), float(r)) for t, e, r in zip(time, event, risk)],
                               "time bigint, event boolean, risk double")
    row = CI.concordance_index(df).first()
    want = R.concordance(time, event, risk)
    assert (row["comparable"], row["concordant"], row["tied"]) == want
    assert row["c_index"] == pytest.approx((want[1] + 0.5 * want[2]) / want[0])


def test_concordance_of_one_risk_is_a_half(spark):
    df = spark.createDataFrame([(1, True, 2.0), (2, True, 2.0), (3, False, 2.0)],
                               "time bigint, event boolean, risk double")
    assert CI.concordance_index(df).first()["c_index"] == 0.5


def test_reports_on_study(dataset):
    cohort, cells = dataset
    effects, summary = C.clinical_report(cohort)
    assert {r["covariate"] for r in effects.collect()} == set(C.CLINICAL_COVARIATES)
    effects, summary, missing = C.panel_report(cohort, cells, SIGNATURE_PANEL)
    models = {r["model"]: r for r in summary.collect()}
    assert effects.count() == 7 and missing == []
    assert models["clinical"]["n"] == models["panel"]["n"]
    assert models["panel"]["log_likelihood"] >= models["clinical"]["log_likelihood"]
    assert 0 <= models["panel"]["c_index"] <= 1

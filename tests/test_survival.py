import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.functions.clinical import with_model_columns
from cohortmill.functions.fixed import SIGNATURE_PANEL
from cohortmill.operators import survival as S
from tests import reference_math as R


@pytest.fixture(scope="module")
def subjects(spark):
    rng = np.random.default_rng(5)
    n = 400
    time, event = rng.integers(1, 120, n), rng.random(n) < 0.5
    high, score = rng.random(n) < 0.4, np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame(
        [(int(t), bool(e), bool(h), float(s), "ABC"[i % 3]) for i, (t, e, h, s) in
         enumerate(zip(time, event, high, score))],
        "time bigint, event boolean, high boolean, score double, arm string")
    return time, event, high, score, df.persist()


def test_km_matches_product_formula(subjects):
    time, event, *_, df = subjects
    got = [(r["time"], r["at_risk"], r["deaths"], r["survival"])
           for r in S.km_curve(df).orderBy("time").collect()]
    for a, b in zip(got, R.km(time, event), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12)


def test_km_textbook_example(spark):
    # remission times of 21 treated leukaemia patients (Freireich 1963), + means censored
    data = "6 6 6 6+ 7 9+ 10 10+ 11+ 13 16 17+ 19+ 20+ 22 23 25+ 32+ 32+ 34+ 35+".split()
    df = spark.createDataFrame([(int(t.rstrip("+")), "+" not in t) for t in data],
                               "time bigint, event boolean")
    curve = {r["time"]: r for r in S.km_curve(df).collect()}
    for t, s in ((6, 0.8571), (7, 0.8067), (10, 0.7529), (13, 0.6902), (16, 0.6275),
                 (22, 0.5378), (23, 0.4482)):
        assert curve[t]["survival"] == pytest.approx(s, abs=5e-5)
    assert curve[13]["ci_lower"] == pytest.approx(0.4316, abs=5e-4)
    assert curve[13]["ci_upper"] == pytest.approx(0.8491, abs=5e-4)
    assert S.km_statistics(S.km_curve(df), at_years=()).first()["median_days"] == 23


def test_km_doubling_rows_keeps_survival(subjects):
    df = subjects[-1]
    one = S.km_curve(df).orderBy("time").collect()
    two = S.km_curve(df.unionAll(df)).orderBy("time").collect()
    for a, b in zip(one, two, strict=True):
        assert b["deaths"] == 2 * a["deaths"] and b["survival"] == pytest.approx(a["survival"])


def test_survival_never_rises(subjects):
    s = [r["survival"] for r in S.km_curve(subjects[-1]).orderBy("time").collect()]
    assert all(a >= b for a, b in zip(s, s[1:]))


def test_origin_row(subjects):
    df = subjects[-1]
    curve = S.km_curve(df, ["arm"], origin=True)
    start = curve.where("time = 0").orderBy("arm").collect()
    assert [(r["arm"], r["survival"], r["deaths"]) for r in start] == [(a, 1.0, 0) for a in "ABC"]


def test_groups_without_or_with_only_events(spark):
    df = spark.createDataFrame(
        [("censored", 5, False), ("censored", 9, False), ("dead", 4, True), ("dead", 4, True)],
        "g string, time bigint, event boolean")
    curve = S.km_curve(df, ["g"])
    stats = {r["g"]: r for r in S.km_statistics(curve, ["g"]).collect()}
    assert stats["censored"]["median_days"] is None and stats["censored"]["surv_1y"] == 1.0
    assert stats["dead"]["median_days"] == 4 and stats["dead"]["surv_1y"] == 0.0
    dead = curve.where("g = 'dead'").first()
    assert (dead["ci_lower"], dead["ci_upper"]) == (0.0, 0.0)


def test_small_strata_are_left_out(spark):
    df = spark.createDataFrame(
        [("I", 1, True), ("I", 2, False), ("II", 3, True), ("Unknown", 4, True)],
        "stage_group string, time bigint, event boolean")
    rows = S.km_by_stratum(df).groupBy("stage_group").agg(F.max("at_risk").alias("n")).collect()
    assert sorted(tuple(r) for r in rows) == [("I", 2), ("overall", 4)]


def test_logrank_two_groups(subjects):
    time, event, high, _, df = subjects
    o, e, v = R.logrank(time, event, high)
    row = S.logrank_two_groups(df).first()
    assert row["events_high"] == o
    assert row["expected_high"] == pytest.approx(e)
    assert row["variance"] == pytest.approx(v)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt((o - e) ** 2 / v / 2)), rel=1e-10)


def test_k_sample_logrank_with_two_strata_is_the_two_sample_test(subjects):
    df = subjects[-1].withColumn("g", F.when(F.col("high"), "h").otherwise("l"))
    two = S.logrank_two_groups(subjects[-1]).first()
    many = S.logrank_strata(df, "g", ("h", "l")).first()
    assert many["chi2"] == pytest.approx(two["chi2"], rel=1e-10)
    assert many["p_value"] == pytest.approx(two["p_value"], rel=1e-9)


def test_k_sample_logrank_sums(subjects):
    m = S.logrank_moments(subjects[-1], "arm", ("A", "B", "C")).first()
    assert m["o0"] + m["o1"] + m["o2"] == pytest.approx(m["e0"] + m["e1"] + m["e2"])
    assert m["v00"] + m["v01"] + m["v02"] == pytest.approx(0, abs=1e-9)


def test_few_known_rows_give_no_p(spark):
    df = spark.createDataFrame([("I", 1, True), ("II", 2, True)], "stage_group string, time bigint, event boolean")
    assert S.logrank_strata(df).first()["p_value"] is None


def test_split_report(subjects):
    time, event, _, score, df = subjects
    high = score >= np.median(score)
    o, e, v = R.logrank(time, event, high)
    rows = {r["high"]: r for r in S.split_report(df).collect()}
    assert rows[True]["n"] == high.sum() and rows[False]["n"] == (~high).sum()
    assert rows[True]["chi2"] == pytest.approx((o - e) ** 2 / v)
    assert rows[True]["median_split"] == np.median(score)


def test_constant_score_has_no_low_group(spark):
    df = spark.createDataFrame([(1, True, 2.0), (2, False, 2.0)], "time bigint, event boolean, score double")
    rows = S.split_report(df).collect()
    assert [(r["high"], r["p_value"]) for r in rows] == [(True, None)]


def test_panel_screen_names_missing_features(dataset):
    cohort, cells = dataset
    rows = {r["symbol"]: r for r in S.panel_screen(
        cells, cohort, {"MKI67": "ENSG00000148773", "NONE": "ENSG99999999999"}).collect()}
    assert rows["NONE"]["note"] and rows["NONE"]["p_value"] is None
    assert rows["MKI67"]["note"] == "" and 0 <= rows["MKI67"]["p_value"] <= 1


def test_versioned_ids_are_found(spark):
    cells = spark.createDataFrame([("s", "ENSG1.5", 1.0), ("s", "ENSG1.12", 2.0), ("s", "ENSG12", 3.0)],
                                  "sample_id string, feature_id string, value double")
    got = {r["symbol"]: r["feature_id"] for r in
           S.named_features(cells, {"A": "ENSG1", "B": "ENSG12", "C": "ENSG2"}).collect()}
    assert got == {"A": "ENSG1.12", "B": "ENSG12", "C": None}


def test_signature_score(dataset):
    cohort, cells = dataset
    wide = cells.groupBy("sample_id").pivot("feature_id").agg(F.first("value")).toPandas().set_index("sample_id")
    want = 0
    for base, sign in SIGNATURE_PANEL.values():
        x = np.log2(wide[base] + 1)
        want = want + sign * (x - x.mean()) / x.std(ddof=0)
    got = S.signature_score(cells, SIGNATURE_PANEL).toPandas().set_index("sample_id")
    assert np.allclose(got.score.loc[want.index], want) and set(got.n_features) == {7}
    report = S.signature_report(cells, cohort, SIGNATURE_PANEL).collect()
    assert sum(r["n"] for r in report) == cohort.count() and report[0]["n_features"] == 7


def test_schoenfeld_published_values(spark):
    df = spark.createDataFrame([(i < 147,) for i in range(400)], "event boolean")
    got = {(r["measure"], r["level"]): r["result"] for r in S.sensitivity(df).collect()}
    assert got["min_hr", 0.8] == pytest.approx(1.5874, abs=1e-4)
    assert got["min_hr", 0.9] == pytest.approx(1.7070, abs=1e-4)
    # power at the minimal hazard ratio is the power asked for
    d = df.agg(F.sum(F.col("event").cast("int")).alias("d"))
    assert d.select(S.power_at(F.col("d"), got["min_hr", 0.8])).first()[0] == pytest.approx(0.8, abs=1e-3)


def test_no_events(spark):
    df = spark.createDataFrame([(False,)], "event boolean")
    got = {(r["measure"], r["level"]): r["result"] for r in S.sensitivity(df).collect()}
    assert got["min_hr", 0.8] == math.inf and got["power", 1.5] == 0.0


def test_stage_report_on_study(dataset):
    cohort, _ = dataset
    rows = S.km_by_stratum(with_model_columns(cohort)).collect()
    assert {r["stage_group"] for r in rows} <= {"overall", "I", "II", "III", "IV"}
    assert all(0 <= r["ci_lower"] <= r["survival"] <= r["ci_upper"] <= 1 for r in rows)


def test_times_that_are_not_whole_days_are_refused(subjects):
    rows = subjects[-1].withColumn("time", F.col("time") / 7)
    for estimate in (S.km_curve, lambda df: S.logrank_two_groups(df), lambda df: S.logrank_strata(df, "arm", ("A", "B"), min_known=0)):
        with pytest.raises(TypeError, match="whole days"):
            estimate(rows)

"""Survival statistics on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.functions.clinical import with_model_columns
from cohortmill.functions.numbers import rounded
from cohortmill.operators import concordance as CI
from cohortmill.operators import cox as C
from cohortmill.operators import survival as S
from cohortmill.operators import testing as T
from cohortmill.plans import adapters as A
from cohortmill.plans import builds
from cohortmill.plans.catalog import ORACLES, query
from cohortmill.session import materialize, written

Z = "1.959963984540054"
# upper tail of the normal distribution by Simpson's rule, since SQL has no erf
P_VALUE = """1 - 2 * (select sum(case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end
   * exp(-power({z} * i / 400.0, 2) / 2)) * {z} / 1200 / sqrt(2 * pi()) from range(0, 401) r(i))"""


def _cohort(spark, sf_dir):
    return with_model_columns(A.cohort(spark, sf_dir)).where(F.col("time") > 0)


def _curve_columns(df, *keys):
    return df.select(
        *keys, "time", "at_risk", "deaths", rounded(F.col("survival")).alias("survival"),
        rounded(F.col("ci_lower")).alias("ci_lower"), rounded(F.col("ci_upper")).alias("ci_upper"),
    )


def _km_sql(groups: str, key: str) -> str:
    return f"""with {A.COHORT_SQL}, g as ({groups}),
k as (select g, time, sum(event::int) d, count(*) c from g group by 1, 2),
r as (select *, sum(c) over (partition by g order by time desc) n from k),
s as (select g, time, n, d,
  exp(sum(case when d = n then -1e300 else ln(1 - d / n::double) end) over w) s,
  sum(case when d = n then 0 else d / (n::double * (n - d)) end) over w v
  from r window w as (partition by g order by time)),
b as (select *, case when s > 0 and s < 1 then sqrt(v) / ln(s) end h from s)
select g as {key}, time, n::bigint as at_risk, d::bigint as deaths, round(s, 6) as survival,
  round(case when s <= 0 then 0 when s >= 1 then 1 else pow(s, exp(-{Z} * h)) end, 6) as ci_lower,
  round(case when s <= 0 then 0 when s >= 1 then 1 else pow(s, exp({Z} * h)) end, 6) as ci_upper
from b"""


@query("km_by_stratum", _km_sql(
    "select stage_group g, time, event from coh where time > 0 and stage_group <> 'Unknown' "
    "union all select 'overall', time, event from coh where time > 0", "stage_group"))
def km_by_stratum(spark, sf_dir):
    return _curve_columns(S.km_by_stratum(_cohort(spark, sf_dir)), "stage_group")


@query("km_overall_with_origin", f"""with {A.COHORT_SQL},
g as (select time, event from coh where time > 0 union all select 0, null),
k as (select time, coalesce(sum(event::int), 0) d, count(event) c from g group by 1),
r as (select *, sum(c) over (order by time desc) n from k),
s as (select time, n, d,
  exp(sum(case when d = n then -1e300 else ln(1 - d / n::double) end) over w) s,
  sum(case when d = n then 0 else d / (n::double * (n - d)) end) over w v
  from r window w as (order by time)),
b as (select *, case when s > 0 and s < 1 then sqrt(v) / ln(s) end h from s)
select time, n::bigint as at_risk, d::bigint as deaths, round(s, 6) as survival,
  round(case when s <= 0 then 0 when s >= 1 then 1 else pow(s, exp(-{Z} * h)) end, 6) as ci_lower,
  round(case when s <= 0 then 0 when s >= 1 then 1 else pow(s, exp({Z} * h)) end, 6) as ci_upper
from b""")
def km_overall_with_origin(spark, sf_dir):
    return _curve_columns(S.km_curve(_cohort(spark, sf_dir), origin=True))


@query("km_statistics", f"""with {A.COHORT_SQL},
g as (select stage_group g, time, event from coh where time > 0 and stage_group <> 'Unknown'
      union all select 'overall', time, event from coh where time > 0),
k as (select g, time, sum(event::int) d, count(*) c from g group by 1, 2),
r as (select *, sum(c) over (partition by g order by time desc) n from k),
s as (select g, time, n, d, exp(sum(case when d = n then -1e300 else ln(1 - d / n::double) end)
      over (partition by g order by time)) s from r)
select g as stage_group, max(n)::bigint as n, sum(d)::bigint as n_events,
  min(time) filter (s <= 0.5) as median_days,
  round(min(time) filter (s <= 0.5) / 365.25, 6) as median_os_years,
  round(coalesce(arg_max(s, time) filter (time <= 365.25), 1), 6) as surv_1y,
  round(coalesce(arg_max(s, time) filter (time <= 1095.75), 1), 6) as surv_3y,
  round(coalesce(arg_max(s, time) filter (time <= 1826.25), 1), 6) as surv_5y
from s group by 1""")
def km_statistics(spark, sf_dir):
    stats = S.km_statistics(S.km_by_stratum(_cohort(spark, sf_dir)), ["stage_group"])
    return stats.select("stage_group", "n", "n_events", "median_days", *[
        rounded(F.col(c)).alias(c) for c in ("median_os_years", "surv_1y", "surv_3y", "surv_5y")])


# ---- log-rank ---------------------------------------------------------------------

def _logrank_sql(rows: str) -> str:
    """CTEs from rows(f, high, time, event) to test(f, n_high, ..., chi2) and pv(f, p)."""
    return f"""k as (select f, time, sum(high::int) c1, sum((not high)::int) c0,
    sum((high and event)::int) d1, sum((not high and event)::int) d0 from {rows} group by 1, 2),
r as (select *, sum(c1) over w n1, sum(c0) over w n0
  from k window w as (partition by f order by time desc)),
m as (select f, sum(n1 * (d1 + d0) / (n1 + n0)::double) e,
  sum(coalesce(n1 * n0 * (d1 + d0) * (n1 + n0 - d1 - d0)::double
      / nullif(pow(n1 + n0, 2) * (n1 + n0 - 1), 0), 0)) v
  from r where d1 + d0 > 0 group by 1),
test as (select z.f, n_high, n_low, events_high, events_low, e, v,
  case when n_high > 0 and n_low > 0 then pow(events_high - e, 2) / nullif(v, 0) end chi2
  from (select f, sum(c1)::bigint n_high, sum(c0)::bigint n_low, sum(d1)::bigint events_high,
        sum(d0)::bigint events_low from k group by 1) z left join m on m.f = z.f),
pv as (select f, {P_VALUE.format(z='sqrt(chi2)')} p from test)"""


@query("logrank_median_split", f"""with {A.COHORT_SQL},
md as (select quantile_cont(age_at_index, 0.5) q from coh where time > 0),
marked as (select 1 f, age_at_index >= q high, time, event from coh, md where time > 0),
{_logrank_sql('marked')}
select n_high, n_low, events_high, events_low, round(e, 6) as expected_high,
  round(v, 6) as variance, round(chi2, 6) as chi2, round(p, 8) as p_value
from test join pv on pv.f = test.f""")
def logrank_median_split(spark, sf_dir):
    marked = S.median_split(_cohort(spark, sf_dir), (), "age_at_index")
    return S.logrank_two_groups(marked).select(
        "n_high", "n_low", "events_high", "events_low",
        *[rounded(F.col(c)).alias(c) for c in ("expected_high", "variance", "chi2")],
        rounded(F.col("p_value"), 8).alias("p_value"))


_STRATA_SQL = f"""with {A.COHORT_SQL},
day as (select time, {', '.join(
    f"sum((stage_group = '{g}')::int) c{i}, sum((stage_group = '{g}' and event)::int) d{i}"
    for i, g in enumerate(('I', 'II', 'III', 'IV')))}
  from coh where time > 0 and stage_group <> 'Unknown' group by 1),
r as (select *, {', '.join(f"sum(c{i}) over w::double n{i}" for i in range(4))}
  from day window w as (order by time desc)),
s as (select *, n0 + n1 + n2 + n3 n, (d0 + d1 + d2 + d3)::double d from r
  where d0 + d1 + d2 + d3 > 0),
t as (select *, d * coalesce((n - d) / nullif(n - 1, 0), 1) q from s),
mo as (select {', '.join(f"sum(d{i})::double o{i}, sum(n{i} * d / n) e{i}" for i in range(4))},
  {', '.join(f"sum(q * n{i} / n * ({int(i == j)} - n{j} / n)) v{i}{j}"
             for i in range(4) for j in range(i, 4))} from t)"""


@query("logrank_strata_moments", _STRATA_SQL + " select " + ", ".join(
    f"round({c}, 5) as {c}" for c in
    [f"{x}{i}" for x in "oe" for i in range(4)]
    + [f"v{i}{j}" for i in range(4) for j in range(i, 4)]) + " from mo")
def logrank_strata_moments(spark, sf_dir):
    row = S.logrank_moments(_cohort(spark, sf_dir), "stage_group", ("I", "II", "III", "IV"))
    return row.select(*[rounded(F.col(c), 5).alias(c) for c in row.columns])


@query("logrank_strata", _STRATA_SQL + """, g as (select o0 - e0 a, o1 - e1 b, o2 - e2 c,
  v00 * (v11 * v22 - v12 * v12) - v01 * (v01 * v22 - v12 * v02)
  + v02 * (v01 * v12 - v11 * v02) det, * from mo),
x as (select (a * a * (v11 * v22 - v12 * v12) + b * b * (v00 * v22 - v02 * v02)
  + c * c * (v00 * v11 - v01 * v01) + 2 * a * b * (v02 * v12 - v01 * v22)
  + 2 * a * c * (v01 * v12 - v02 * v11) + 2 * b * c * (v01 * v02 - v00 * v12)) / det chi2 from g)
select (select count(*) from coh where time > 0 and stage_group <> 'Unknown') as n_known,
  4 as n_strata, round(chi2, 5) as chi2,
  round(""" + P_VALUE.format(z="sqrt(chi2)")
       + " + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2), 8) as p_value from x")
def logrank_strata(spark, sf_dir):
    return S.logrank_strata(_cohort(spark, sf_dir)).select(
        "n_known", "n_strata", rounded(F.col("chi2"), 5).alias("chi2"),
        rounded(F.col("p_value"), 8).alias("p_value"))


# ---- splits by feature --------------------------------------------------------------

_SPLIT_SQL = f"""with {A.COHORT_SQL}, {A.EXPRESSION_SQL},
rows_ as (select feature_id f, value, time, event from expr join coh using (sample_id)
  where time > 0),
med as (select f, quantile_cont(value::double, 0.5) q from rows_ group by 1),
marked as (select rows_.f, value >= q high, time, event from rows_ join med on med.f = rows_.f),
{_logrank_sql('marked')},
hk as (select f, time, sum(event::int) d, count(*) c from marked where high group by 1, 2),
hr as (select *, sum(c) over (partition by f order by time desc) n from hk),
hs as (select f, time, exp(sum(case when d = n then -1e300 else ln(1 - d / n::double) end)
  over (partition by f order by time)) s from hr),
hm as (select f, min(time) filter (s <= 0.5) md from hs group by 1),
res as (select test.f feature_id, n_high, n_low, events_high, events_low,
  round(e, 6) expected_high, round(v, 6) variance, round(chi2, 6) chi2, round(p, 8) p_value,
  round(q, 6) median_split, md median_days_high, p
  from test join pv on pv.f = test.f join med on med.f = test.f left join hm on hm.f = test.f)"""
_SPLIT_COLUMNS = ("n_high", "n_low", "events_high", "events_low", "expected_high", "variance",
                  "chi2", "p_value", "median_split", "median_days_high")


def _split_columns(df, *keys):
    digits = {"expected_high": 6, "variance": 6, "chi2": 6, "p_value": 8, "median_split": 6}
    return df.select(*keys, *[
        rounded(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
        for c in _SPLIT_COLUMNS])


def _matrix(spark, sf_dir):
    return written(A.expression(spark, sf_dir), "feature_id")


@query("split_screen_all_features", _SPLIT_SQL + f""" select feature_id,
  {', '.join(_SPLIT_COLUMNS)} from res""")
def split_screen_all_features(spark, sf_dir):
    cells = A.expression(spark, sf_dir)  # written once, with time and event
    return _split_columns(S.split_screen(cells, _cohort(spark, sf_dir)),
                          "feature_id")


@query("panel_screen", _SPLIT_SQL + f""" select symbol, feature_id,
  {', '.join(_SPLIT_COLUMNS)}, case when feature_id is null then 'not in the matrix' else '' end
  as note from (values ('M1', 'Brand#1'), ('M2', 'Brand#12'), ('M3', 'Brand#25'),
  ('ABSENT', 'Brand#99')) n(symbol, base) left join res on feature_id = base""")
def panel_screen(spark, sf_dir):
    screened = S.panel_screen(_matrix(spark, sf_dir), _cohort(spark, sf_dir), A.MARKERS)
    return _split_columns(screened, "symbol", "feature_id", "note")


def _report_sql(rows: str, extra: str = "") -> str:
    return f"""md as (select quantile_cont(value::double, 0.5) q from {rows}),
marked as (select 1 f, value >= q high, time, event from {rows}, md),
{_logrank_sql('marked')},
hk as (select high, time, sum(event::int) d, count(*) c from marked group by 1, 2),
hr as (select *, sum(c) over (partition by high order by time desc) n from hk),
hs as (select high, time, n, d,
  exp(sum(case when d = n then -1e300 else ln(1 - d / n::double) end)
  over (partition by high order by time)) s from hr)
select high, max(n)::bigint as n, sum(d)::bigint as n_events,
  min(time) filter (s <= 0.5) as median_days,
  round(coalesce(arg_max(s, time) filter (time <= 365.25), 1), 6) as surv_1y,
  round(coalesce(arg_max(s, time) filter (time <= 1095.75), 1), 6) as surv_3y,
  round(coalesce(arg_max(s, time) filter (time <= 1826.25), 1), 6) as surv_5y,
  (select round(q, 6) from md) as median_split, (select round(chi2, 6) from test) as chi2,
  (select round(p, 8) from pv) as p_value{extra}
from hs group by 1"""


def _report_columns(df, *more):
    return df.select("high", "n", "n_events", "median_days", *[
        rounded(F.col(c), 8 if c == "p_value" else 6).alias(c)
        for c in ("surv_1y", "surv_3y", "surv_5y", "median_split", "chi2", "p_value")], *more)


@query("feature_split_report", f"""with {A.COHORT_SQL}, {A.EXPRESSION_SQL},
rows_ as (select value, time, event from expr join coh using (sample_id)
  where time > 0 and feature_id = 'Brand#12'),
{_report_sql('rows_', ", 'M2' as symbol")}""")
def feature_split_report(spark, sf_dir):
    rep = S.feature_split_report(_matrix(spark, sf_dir), _cohort(spark, sf_dir), "M2", "Brand#12")
    return _report_columns(rep, "symbol")


_SIGNATURE_SQL = f"""{A.EXPRESSION_SQL},
pan as (select * from (values {', '.join(
    f"('{b}', {sign})" for b, sign in A.PANEL.values())}) p(feature_id, sign)),
lg as (select sample_id, feature_id, sign, log2(value + 1) x from expr join pan using (feature_id)),
st as (select feature_id, avg(x) mu, stddev_pop(x) sd from lg group by 1),
zs as (select sample_id, feature_id, sign, (x - mu) / sd z from lg join st using (feature_id)
  where sd > 0),
sc as (select sample_id, sum(sign * z) score, count(*)::int n_features from zs group by 1)"""


@query("signature_score", f"""with {_SIGNATURE_SQL}
select sample_id, round(score, 6) as score, n_features from sc""")
def signature_score(spark, sf_dir):
    return S.signature_score(_matrix(spark, sf_dir), A.PANEL).select(
        "sample_id", rounded(F.col("score")).alias("score"), "n_features")


@query("signature_report", f"""with {A.COHORT_SQL}, {_SIGNATURE_SQL},
rows_ as (select score value, time, event from sc join coh using (sample_id) where time > 0),
{_report_sql('rows_', ", (select max(n_features) from sc) as n_features")}""")
def signature_report(spark, sf_dir):
    rep = S.signature_report(_matrix(spark, sf_dir), _cohort(spark, sf_dir), A.PANEL)
    return _report_columns(rep, "n_features")


# ---- many tests ---------------------------------------------------------------------

@query("fdr_of_screen", _SPLIT_SQL + """,
t as (select feature_id, p, row_number() over (order by p) rk, count(*) over () m from res
  where p is not null),
q as (select *, least(1, min(p * m / rk) over (order by p desc, rk desc)) q from t)
select res.feature_id, round(res.p, 8) as p_value, round(q, 7) as q_value,
  coalesce(res.p < 0.05, false) as reject_raw, coalesce(q < 0.05, false) as reject_fdr
from res left join q on q.feature_id = res.feature_id""")
def fdr_of_screen(spark, sf_dir):
    screen = materialize(S.split_screen(_matrix(spark, sf_dir), _cohort(spark, sf_dir))
                         .select("feature_id", "p_value"))
    return T.multiple_testing(screen).select(
        "feature_id", rounded(F.col("p_value"), 8).alias("p_value"),
        rounded(F.col("q_value"), 7).alias("q_value"), "reject_raw", "reject_fdr")


def _event_tests(spark, sf_dir):
    """A p-value per event: its value on an exponential scale, unknown for errors."""
    return A.table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("event_type") != "error", F.exp(-F.col("value") / 10.0)).alias("p_value"))


_EVENT_TEST_SQL = """with t as (select event_id,
  case when event_type <> 'error' then exp(-value / 10.0) end p from events),
m as (select count(p) m from t),
d as (select p, count(*) c from t where p is not null group by 1),
r as (select p, sum(c) over (order by p) rk from d),
q as (select p, least(1, min(p * m / rk) over (order by p desc)) q from r, m)"""


@query("fdr_q_values", _EVENT_TEST_SQL + """
select event_id, round(t.p, 6) as p_value, round(q, 6) as q_value
from t left join q on q.p = t.p""")
def fdr_q_values(spark, sf_dir):
    return T.benjamini_hochberg(_event_tests(spark, sf_dir)).select(
        "event_id", rounded(F.col("p_value")).alias("p_value"),
        rounded(F.col("q_value")).alias("q_value"))


@query("fdr_summary", _EVENT_TEST_SQL + """
select count(t.p) as n_tested, count(*) filter (t.p < 0.05) as n_sig_raw,
  count(*) filter (q < 0.05) as n_sig_fdr from t left join q on q.p = t.p""")
def fdr_summary(spark, sf_dir):
    return T.testing_summary(T.multiple_testing(_event_tests(spark, sf_dir)))


def _sensitivity_sql(group: str) -> str:
    return f"""with {A.COHORT_SQL},
e as (select {group} as stage_group, coalesce(sum(event::int), 0)::bigint n_events from coh
  where time > 0 group by 1),
c as (select stage_group, n_events, 'min_hr' as measure, at_ as level,
   case when n_events > 0 then exp(({Z} + zb) / sqrt(n_events * 0.25)) else 'inf'::double end as result
  from e, (values (0.8::double, 0.8416212335729143), (0.9::double, 1.2815515655446008)) p(at_, zb)
  union all
  select stage_group, n_events, 'power', hr,
   case when n_events > 0 then 1 - ({P_VALUE.format(
       z=f'(sqrt(n_events * 0.25) * ln(hr) - {Z})')}) / 2 else 0 end
  from e, (values (1.3::double), (1.5::double), (1.75::double), (2.0::double)) h(hr))
select stage_group, n_events, measure, level, round(result, 6) as result from c"""


@query("sensitivity_by_stage", _sensitivity_sql("stage_group"))
def sensitivity_by_stage(spark, sf_dir):
    return S.sensitivity(_cohort(spark, sf_dir), ["stage_group"]).withColumn(
        "result", rounded(F.col("result")))


# ---- Cox and concordance ------------------------------------------------------------

_X = ("age_at_index / 1000.0", "(coalesce(gender = 'male', false))::int::double",
      "case stage_group when 'I' then 1 when 'II' then 2 when 'III' then 3 else 4 end::double")
_MODEL_SQL = f"""with {A.COHORT_SQL},
x as (select time, event, {', '.join(f"{x} x{i}" for i, x in enumerate(_X))} from coh
  where time > 0 and stage_group <> 'Unknown' and age_at_index is not null)"""
_UPPER = [(i, j) for i in range(3) for j in range(i, 3)]


def _moment_sql(tag: str, beta: str, size: int = 3) -> str:
    """CTEs giving mom{tag}(ll, u0.., i0_0..) at the coefficients in table ``beta``."""
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    keys = ["0"] + [f"1_{i}" for i in range(size)] + [f"2_{i}_{j}" for i, j in upper]
    weight = {"0": "r"} | {f"1_{i}": f"r * x{i}" for i in range(size)} | {
        f"2_{i}_{j}": f"r * x{i} * x{j}" for i, j in upper}
    eta = " + ".join(f"b{i} * x{i}" for i in range(size))
    return f"""rk{tag} as (select x.*, {eta} eta, exp({eta}) r from x, {beta}),
dy{tag} as (select time, sum(event::int) d, sum(event::int * eta) de,
  {', '.join(f"sum(event::int * x{i}) dx{i}" for i in range(size))},
  {', '.join(f"sum({w}) p{k}, sum(event::int * {w}) d{k}" for k, w in weight.items())}
  from rk{tag} group by 1),
rs{tag} as (select *, {', '.join(f"sum(p{k}) over w s{k}" for k in keys)}
  from dy{tag} window w as (order by time desc)),
ti{tag} as (select *, unnest(range(d::bigint)) l from rs{tag} where d > 0),
ad{tag} as (select l, de, {', '.join(f"dx{i}" for i in range(size))},
  {', '.join(f"s{k} - l / d::double * d{k} a{k}" for k in keys)} from ti{tag}),
mom{tag} as (select sum(case when l = 0 then de else 0 end - ln(a0)) ll,
  {', '.join(f"sum(case when l = 0 then dx{i} else 0 end - a1_{i} / a0) u{i}" for i in range(size))},
  {', '.join(f"sum(a2_{i}_{j} / a0 - a1_{i} * a1_{j} / (a0 * a0)) i{i}_{j}" for i, j in upper)}
  from ad{tag})"""


def _inverse_sql(tag: str) -> str:
    m = {(i, j): f"i{min(i, j)}_{max(i, j)}" for i in range(3) for j in range(3)}

    def cofactor(i, j):
        a, b = [k for k in range(3) if k != i]
        c, e = [k for k in range(3) if k != j]
        sign = "-" if (i + j) % 2 else ""
        return f"{sign}({m[a, c]} * {m[b, e]} - {m[a, e]} * {m[b, c]})"

    det = " + ".join(f"{m[0, j]} * ({cofactor(0, j)})" for j in range(3))
    cells = ", ".join(f"({cofactor(j, i)}) / ({det}) c{i}{j}" for i in range(3) for j in range(3))
    return f"inv{tag} as (select *, {cells} from mom{tag})"


def _newton_sql(tag: str = "", steps: int = 7) -> str:
    """Newton steps of the first three covariates; the tag tells two such fits apart."""
    parts = [f"beta{tag}0 as (select 0.0::double b0, 0.0::double b1, 0.0::double b2)"]
    for k in range(steps):
        moves = ", ".join(f"b{i} + c{i}0 * u0 + c{i}1 * u1 + c{i}2 * u2 b{i}" for i in range(3))
        parts += [_moment_sql(f"{tag}{k}", f"beta{tag}{k}"), _inverse_sql(f"{tag}{k}"),
                  f"beta{tag}{k + 1} as materialized (select {moves} from inv{tag}{k}, beta{tag}{k})"]
    return ",\n".join(parts)


def _model_frame(spark, sf_dir):
    rows = C.model_rows(_cohort(spark, sf_dir))
    return rows.withColumns({
        "x0": F.col("age_at_index") / 1000.0, "x1": F.col("gender_male").cast("double"),
        "x2": F.col("stage_numeric").cast("double")})


@query("cox_moments", f"""{_MODEL_SQL},
b as (select 0.1::double b0, -0.2::double b1, 0.3::double b2),
{_moment_sql('', 'b')}
select {', '.join(f"round({c}, 4) as {c}" for c in
                  ['ll', 'u0', 'u1', 'u2'] + [f'i{i}_{j}' for i, j in _UPPER])} from mom""")
def cox_moments(spark, sf_dir):
    row = C.moments(_model_frame(spark, sf_dir).select("time", "event", "x0", "x1", "x2"), 3,
                    (0.1, -0.2, 0.3))
    return row.select(*[rounded(F.col(c), 4).alias(c) for c in row.columns])


@query("cox_clinical_effects", f"""{_MODEL_SQL}, {_newton_sql()},
e as (select 'age' covariate, b0 coef, sqrt(c00) se from beta7, inv6
  union all select 'male', b1, sqrt(c11) from beta7, inv6
  union all select 'stage', b2, sqrt(c22) from beta7, inv6)
select covariate, round(coef, 6) as coef, round(se, 6) as se, round(exp(coef), 6) as hr,
  round(exp(coef - {Z} * se), 6) as ci_lower, round(exp(coef + {Z} * se), 6) as ci_upper,
  round({P_VALUE.format(z='abs(coef / se)')}, 6) as p_value,
  case when coef < 0 then 'protective' else 'risk' end as direction from e""")
def cox_clinical_effects(spark, sf_dir):
    rows = _model_frame(spark, sf_dir).withColumnsRenamed(
        {"x0": "age", "x1": "male", "x2": "stage"})
    fit = C.fit_cox(rows, ("age", "male", "stage"))
    return C.effect_table(spark, fit).select(
        "covariate", *[rounded(F.col(c)).alias(c)
                       for c in ("coef", "se", "hr", "ci_lower", "ci_upper", "p_value")],
        "direction")


@query("cox_clinical_summary", f"""{_MODEL_SQL}, {_newton_sql()}, {_moment_sql('f', 'beta7')},
rk as (select time, event, b0 * x0 + b1 * x1 + b2 * x2 risk from x, beta7),
pr as (select a.risk ra, b.risk rb from rk a join rk b
  on a.event and (b.time > a.time or (b.time = a.time and not b.event)))
select 'clinical' as model, round((select (count(*) filter (ra > rb) + 0.5 * count(*) filter
  (ra = rb)) / count(*) from pr), 5) as c_index, 0.0::double as penalizer,
  (select count(*) from x) as n, (select count(*) filter (event) from x) as n_events,
  round((select ll from momf), 5) as log_likelihood""")
def cox_clinical_summary(spark, sf_dir):
    return C.clinical_report(_cohort(spark, sf_dir))[1].withColumns({
        c: rounded(F.col(c), 5) for c in ("c_index", "log_likelihood")})


_GENES = list(A.PANEL)
_SIZE = 3 + len(_GENES)


def _elimination_sql(tag: str, size: int) -> str:
    """inv{tag}(c): the inverse of the information in mom{tag}, by elimination on nested lists."""
    rows = ", ".join("[" + ", ".join([f"i{min(i, j)}_{max(i, j)}" for j in range(size)]
                                     + [str(float(i == j)) for j in range(size)]) + "]" for i in range(size))
    return f"""aug{tag} as (select [{rows}] as m from mom{tag}),
gj{tag} as (select 0 as k, m from aug{tag} union all select k + 1, [[
  case when i = k + 1 then m[i][j] / m[i][i] else m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] end
  for j in range(1, {2 * size + 1})] for i in range(1, {size + 1})] from gj{tag} where k < {size}),
inv{tag} as (select [[m[i][j + {size}] for j in range(1, {size + 1})] for i in range(1, {size + 1})] as c
  from gj{tag} where k = {size})"""


def _panel_newton_sql(steps: int = 7) -> str:
    parts = ["beta0 as (select " + ", ".join(f"0.0::double b{i}" for i in range(_SIZE)) + ")"]
    for k in range(steps):
        parts += [_moment_sql(str(k), f"beta{k}", _SIZE), _elimination_sql(str(k), _SIZE)]
        moves = ", ".join(f"b{i} + " + " + ".join(f"c[{i + 1}][{j + 1}] * u{j}" for j in range(_SIZE)) + f" b{i}" for i in range(_SIZE))
        parts.append(f"beta{k + 1} as materialized (select {moves} from inv{k}, mom{k}, beta{k})")
    return ",\n".join(parts)


_PANEL_SQL = f"""with recursive {A.COHORT_SQL}, {_SIGNATURE_SQL},
wide as (select sample_id, {', '.join(f"max(z) filter (feature_id = '{A.PANEL[g][0]}') as z{i}" for i, g in enumerate(_GENES))}
  from zs group by 1),
x as materialized (select time, event, {', '.join(f"{x} x{i}" for i, x in enumerate(_X))},
  {', '.join(f"z{i} as x{i + 3}" for i in range(len(_GENES)))} from coh join wide using (sample_id)
  where time > 0 and stage_group <> 'Unknown' and age_at_index is not null
    and {' and '.join(f"z{i} is not null" for i in range(len(_GENES)))}),
{_panel_newton_sql()},
e as ({' union all '.join(f"select 'g_{g}' as covariate, b{i + 3} as coef, sqrt(c[{i + 4}][{i + 4}]) as se from beta7, inv6"
                          for i, g in enumerate(_GENES))}),
t as (select *, {P_VALUE.format(z='abs(coef / se)')} as p_value from e)"""


@query("cox_panel_effects", f"""{_PANEL_SQL}
select covariate, round(coef, 6) as coef, round(se, 6) as se, round(exp(coef), 6) as hr,
  round(exp(coef - {Z} * se), 6) as ci_lower, round(exp(coef + {Z} * se), 6) as ci_upper, round(coef / se, 5) as z,
  round(p_value, 6) as p_value, case when coef < 0 then 'protective' else 'risk' end as direction,
  p_value < 0.05 as significant from t""")
def cox_panel_effects(spark, sf_dir):
    effects = C.panel_report(_cohort(spark, sf_dir), _matrix(spark, sf_dir), A.PANEL)[0]
    return effects.withColumns({c: rounded(F.col(c), 5 if c == "z" else 6) for c in
                                ("coef", "se", "hr", "ci_lower", "ci_upper", "z", "p_value")})


def _summary_sql(model: str, size: int, beta: str, moments: str) -> str:
    risk = " + ".join(f"b{i} * x{i}" for i in range(size))
    return f"""select '{model}' as model, round((select (count(*) filter (a.r > b.r) + 0.5 * count(*) filter (a.r = b.r)) / count(*)
    from (select time, event, {risk} as r from x, {beta}) a join (select time, event, {risk} as r from x, {beta}) b
    on a.event and (b.time > a.time or (b.time = a.time and not b.event))), 5) as c_index, 0.0::double as penalizer,
  (select count(*) from x) as n, (select count(*) filter (event) from x) as n_events,
  round((select ll from {moments}), 5) as log_likelihood"""


@query("cox_panel_summary", f"""{_PANEL_SQL}, {_moment_sql("f", "beta7", _SIZE)},
{_newton_sql("c")}, {_moment_sql("cf", "betac7")}
{_summary_sql("clinical", 3, "betac7", "momcf")} union all {_summary_sql("panel", _SIZE, "beta7", "momf")}""")
def cox_panel_summary(spark, sf_dir):
    summary = C.panel_report(_cohort(spark, sf_dir), _matrix(spark, sf_dir), A.PANEL)[1]
    return summary.withColumns({c: rounded(F.col(c), 5) for c in ("c_index", "log_likelihood")})


@query("fdr_of_cox_panel", f"""{_PANEL_SQL},
r as (select covariate as name, p_value, row_number() over (order by p_value) as k, count(*) over () as n from t),
q as (select *, least(1.0, min(p_value * n / k) over (order by k desc)) as q_value from r)
select name, round(p_value, 6) as p_value, round(q_value, 6) as q_value, p_value < 0.05 as reject_raw,
  q_value < 0.05 as reject_fdr, 'cox' as source from q""")
def fdr_of_cox_panel(spark, sf_dir):
    tests = builds.panel_testing(_cohort(spark, sf_dir), _matrix(spark, sf_dir), A.PANEL, "cox")
    return tests.withColumns({c: rounded(F.col(c)) for c in ("p_value", "q_value")})


@query("fdr_of_single_genes", _SPLIT_SQL + f""",
sg as (select name, p from (values {', '.join(f"('{g}', '{A.PANEL[g][0]}')" for g in A.PANEL)}) n(name, base)
  left join res on feature_id = base),
sk as (select *, row_number() over (order by p) as k, count(*) over () as n from sg where p is not null),
sq as (select *, least(1.0, min(p * n / k) over (order by k desc)) as q_value from sk)
select sg.name, round(sg.p, 6) as p_value, round(q_value, 6) as q_value, coalesce(sg.p < 0.05, false) as reject_raw,
  coalesce(q_value < 0.05, false) as reject_fdr, 'single_gene' as source from sg left join sq on sq.name = sg.name""")
def fdr_of_single_genes(spark, sf_dir):
    tests = builds.panel_testing(_cohort(spark, sf_dir), _matrix(spark, sf_dir), A.PANEL)
    return tests.withColumns({c: rounded(F.col(c)) for c in ("p_value", "q_value")})


_TESTED = "name, p_value, q_value, reject_raw, reject_fdr, null as n_events, null as level"


@query("rigor_report", f"""select 'fdr_single_gene' as part, {_TESTED} from ({ORACLES["fdr_of_single_genes"]})
union all select 'fdr_cox', {_TESTED} from ({ORACLES["fdr_of_cox_panel"]})
union all select 'sensitivity', measure, result, null, null, null, n_events, level from ({_sensitivity_sql("'all'")})""")
def rigor_report(spark, sf_dir):
    """The three parts of the report in one table; ``p_value`` of a sensitivity row is its result."""
    parts = builds.rigor_report(_cohort(spark, sf_dir), _matrix(spark, sf_dir), A.PANEL)
    none = {"n_events": F.lit(None).cast("bigint"), "level": F.lit(None).cast("double")}
    tested = [parts[name].withColumns({"part": F.lit(name), **none, **{
        c: rounded(F.col(c)) for c in ("p_value", "q_value")}}) for name in ("fdr_single_gene", "fdr_cox")]
    power = parts["sensitivity"].select(
        F.lit("sensitivity").alias("part"), F.col("measure").alias("name"), rounded(F.col("result")).alias("p_value"),
        F.lit(None).cast("double").alias("q_value"), *[F.lit(None).cast("boolean").alias(c) for c in ("reject_raw", "reject_fdr")],
        "n_events", "level")
    return tested[0].unionByName(tested[1]).drop("source").unionByName(power)


_CONCORDANCE_SQL = f"""with {A.COHORT_SQL},
x as (select time, event, floor(age_at_index / 100) risk from coh where time > 0),
k as (select time, event, risk, count(*) c from x group by 1, 2, 3),
pr as (select a.c * b.c w, a.risk ra, b.risk rb from k a join k b
  on a.event and (b.time > a.time or (b.time = a.time and not b.event))),
s as (select coalesce(sum(w), 0) comparable, coalesce(sum(w) filter (ra > rb), 0) concordant,
  coalesce(sum(w) filter (ra = rb), 0) tied from pr)
select comparable::bigint as comparable, concordant::bigint as concordant, tied::bigint as tied,
  round((concordant + 0.5 * tied) / comparable::double, 6) as c_index from s"""


@query("concordance_of_score", _CONCORDANCE_SQL)
def concordance_of_score(spark, sf_dir):
    rows = _cohort(spark, sf_dir).withColumn("risk", F.floor(F.col("age_at_index") / 100))
    return CI.concordance_index(rows).select(
        "comparable", "concordant", "tied", rounded(F.col("c_index")).alias("c_index"))

"""Readiness, train and test exports and manifests on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortmill.functions.numbers import rounded
from cohortmill.operators import components as K
from cohortmill.operators import export as E
from cohortmill.operators import readiness as R
from cohortmill.plans import adapters as A
from cohortmill.plans.catalog import query
from cohortmill.plans.component_sql import component_sql
from cohortmill.session import checkpoint_dir, materialize, written
from cohortmill.sources import sinks

SEED, SHARE, TOP = 7, 0.25, 10


def _matrix(spark, sf_dir):
    return written(A.expression(spark, sf_dir), "feature_id")


def _cohort(spark, sf_dir):
    return A.cohort(spark, sf_dir).where("time > 0")


# ---- readiness ------------------------------------------------------------------------

_READY = f"""with {A.COHORT_SQL}, {A.EXPRESSION_SQL},
c as (select *, site::varchar as st from coh),
a as (select count(*) n, sum(event::int) d, count(*) filter (not event) cens,
  100.0 * count(age_at_index) / count(*) fa, 100.0 * count(gender) / count(*) fg,
  100.0 * count(ajcc_pathologic_stage) / count(*) fs from c),
s as (select max(n) / min(n)::double im from (select count(*) n from c
  where stage_group <> 'Unknown' group by stage_group)),
t as (select count(*) k, max(n) / min(n)::double im from (select count(*) n from c group by st)),
f as (select count(*) p, sum(cells) cells, sum(zeros) zeros, count(*) filter (lo = hi) z from
  (select feature_id, count(*) cells, count(*) filter (value = 0) zeros, min(value) lo,
   max(value) hi from expr group by 1)),
rows_ as (
  select 'n_samples' measure, n::double as value,
    case when n >= 100 then 'green' when n >= 30 then 'yellow' else 'red' end status from a
  union all select 'n_features', p, 'info' from f
  union all select 'features_per_sample', p / n::double, case when p / n::double <= 2 then 'green'
    when p / n::double <= 50 then 'yellow' else 'red' end from a, f
  union all select 'events_per_feature', d / p::double, case when d / p::double >= 10 then 'green'
    when d / p::double >= 1 then 'yellow' else 'red' end from a, f
  union all select 'n_events', d, case when d >= 100 then 'green' when d >= 50 then 'yellow'
    else 'red' end from a
  union all select 'censoring_pct', 100.0 * cens / n, case when 100.0 * cens / n < 70 then 'green'
    when 100.0 * cens / n < 90 then 'yellow' else 'red' end from a
  union all select 'completeness', least(fa, fg, fs), case when least(fa, fg, fs) < 80 then 'red'
    when least(fa, fg, fs) < 95 then 'yellow' else 'green' end from a
  union all select 'filled_age_at_index', fa, 'detail' from a
  union all select 'filled_gender', fg, 'detail' from a
  union all select 'filled_ajcc_pathologic_stage', fs, 'detail' from a
  union all select 'stage_imbalance', im, case when im <= 3 then 'green' when im <= 10 then 'yellow'
    else 'red' end from s
  union all select 'metric', null, 'red'
  union all select 'sparsity_pct', 100.0 * zeros / cells, case when 100.0 * zeros / cells < 20
    then 'green' when 100.0 * zeros / cells < 50 then 'yellow' else 'red' end from f
  union all select 'zero_variance', z, case when z = 0 then 'green' when z <= 0.1 * p
    then 'yellow' else 'red' end from f
  union all select 'n_sites', k, 'detail' from t
  union all select 'site_imbalance', im, case when im <= 5 then 'green' when im <= 20 then 'yellow'
    else 'red' end from t
  union all select 'repeated_cases', n, case when n = 0 then 'green' when n <= 5 then 'yellow' else 'red' end
    from (select count(*) n from (select case_id from c group by 1 having count(*) > 1)))"""


def _report(spark, sf_dir):
    cohort = A.cohort(spark, sf_dir)
    return R.readiness(
        R.cohort_measures(cohort, site=F.col("site").cast("string")),
        R.feature_measures(_matrix(spark, sf_dir)), "counts")


@query("readiness_report", _READY + """ select measure, round(value, 6) as value, status
from rows_""")
def readiness_report(spark, sf_dir):
    return _report(spark, sf_dir).select("measure", rounded(F.col("value")).alias("value"), "status")


@query("readiness_verdict", _READY + """ select count(*) filter (status = 'green') as green,
  count(*) filter (status = 'yellow') as yellow, count(*) filter (status = 'red') as red,
  count(*) filter (status = 'info') as info,
  case when bool_or(status = 'red' and measure in ('n_samples', 'n_events')) then 'red'
    when bool_or(status in ('red', 'yellow')) then 'yellow' else 'green' end as verdict,
  count(*) filter (status in ('red', 'yellow')) as n_actions from rows_""")
def readiness_verdict(spark, sf_dir):
    return R.readiness_verdict(_report(spark, sf_dir)).select(
        "green", "yellow", "red", "info", "verdict",
        F.size("actions").cast("bigint").alias("n_actions"))


def _eta_sql(group: str) -> str:
    return f"""(select sum(n * (m - g) * (m - g)) / (sum(n * (m - g) * (m - g)) + sum(n * v)) from (
  select count(*) n, avg(s) m, var_pop(s) v, any_value(g) g from (
    select {group} k, s, avg(s) over () g from sco) group by k))"""


@query("readiness_with_components", _READY.replace("with ", "with recursive ", 1) + f""",
{component_sql(1)},
sco as (select coh.*, list_dot_product(z, e1.v) as s from pz join coh using (sample_id), e1),
eta as (select {_eta_sql('site')} as by_site, {_eta_sql('stage_group')} as by_stage)
select measure, round(value, 6) as value, status from rows_
union all select 'pc1', round(by_site, 6), case when by_site >= 0.3 and by_site > by_stage then 'red'
  when by_stage >= by_site then 'green' else 'yellow' end from eta
union all select 'pc1_stage', round(by_stage, 6), 'detail' from eta
union all select 'pc1_pct', round(l, 6), 'detail' from e1""")
def readiness_with_components(spark, sf_dir):
    cells, cohort = _matrix(spark, sf_dir), A.cohort(spark, sf_dir)
    site = F.col("site").cast("string")
    variance, scores = K.pca(cells, 1, 2000, clipped=True)
    batch = R.batch_measures(scores, cohort, variance.first()["var_pct"], site=site)
    return R.readiness(R.cohort_measures(cohort, site=site), R.feature_measures(cells), "counts",
                       batch).select("measure", rounded(F.col("value")).alias("value"), "status")


# ---- export ---------------------------------------------------------------------------

_SPLIT = f"""{A.COHORT_SQL}, {A.EXPRESSION_SQL}, kc as (select * from coh where time > 0),
cs as (select case_id, max(event::int) as stratum from kc group by 1),
rk as (select *, row_number() over (partition by stratum order by md5('{SEED}:' || case_id)) r,
  count(*) over (partition by stratum) n from cs),
sp as (select case_id, stratum, r <= round_even(n * {SHARE}, 0) as is_test from rk),
rs as (select kc.*, is_test from kc join sp using (case_id)),
lx as (select expr.sample_id, feature_id, is_test, log2(greatest(value, 0) + 1) x
  from expr join rs using (sample_id)),
ts as (select feature_id, avg(x) mu, stddev_pop(x) sd, var_pop(x) v from lx where not is_test
  group by 1),
sel as (select * from ts where v > 0 order by v desc, feature_id limit {TOP})"""


def _split(spark, sf_dir):
    return E.case_split(_cohort(spark, sf_dir), SHARE, SEED)


@query("case_split", f"with {_SPLIT} select case_id, stratum, is_test from sp")
def case_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query("split_report", f"""with {_SPLIT} select count(*) filter (not is_test) as n_train,
  count(*) filter (is_test) as n_test,
  round(avg(event::int) filter (not is_test), 3) as event_rate_train,
  round(avg(event::int) filter (is_test), 3) as event_rate_test,
  (select count(*) from (select case_id from rs group by 1 having count(distinct is_test) > 1)) as shared_cases,
  not exists (select 1 from rs group by case_id having count(distinct is_test) > 1) as no_leakage from rs""")
def split_report(spark, sf_dir):
    cohort = _cohort(spark, sf_dir)
    return E.split_report(E.split_rows(cohort, E.case_split(cohort, SHARE, SEED)))


@query("train_selected_features", f"""with {_SPLIT}
select feature_id, round(v, 6) as variance, round(mu, 6) as mean from sel""")
def train_selected_features(spark, sf_dir):
    rows = E.split_rows(_cohort(spark, sf_dir), _split(spark, sf_dir))
    chosen = E.train_features(_matrix(spark, sf_dir), rows.where(~F.col("is_test")), TOP)
    return chosen.select("feature_id", rounded(F.col("variance")).alias("variance"),
                         rounded(F.col("mean")).alias("mean"))


@query("scaled_training_cells", f"""with {_SPLIT}
select sample_id, feature_id, is_test, round((x - mu) / sd, 5) as x from lx join sel
using (feature_id)""")
def scaled_training_cells(spark, sf_dir):
    cells = _matrix(spark, sf_dir)
    rows = materialize(E.split_rows(_cohort(spark, sf_dir), _split(spark, sf_dir)))
    chosen = E.train_features(cells, rows.where(~F.col("is_test")), TOP)
    return E.scaled_cells(cells, rows, chosen).withColumn("x", rounded(F.col("x"), 5))


@query("export_labels", f"""with {_SPLIT} select sample_id, case_id, time, event, age_at_index,
  gender, ajcc_pathologic_stage, is_test from rs""")
def export_labels(spark, sf_dir):
    return E.prepare_export(_cohort(spark, sf_dir), _matrix(spark, sf_dir), TOP, SHARE, SEED).labels


def _long(x):
    """The columns of a wide X as rows, so that SQL need not know their names."""
    return x.unpivot("sample_id", [F.col(f"`{c}`") for c in x.columns[1:]], "feature_id", "x").withColumn(
        "x", rounded(F.col("x"), 5))


@query("export_x_test", f"""with {_SPLIT} select sample_id, feature_id, round((x - mu) / sd, 5) as x
from lx join sel using (feature_id) where is_test""")
def export_x_test(spark, sf_dir):
    made = E.prepare_export(_cohort(spark, sf_dir), _matrix(spark, sf_dir), TOP, SHARE, SEED)
    return _long(made.x(True))


@query("export_bundle", f"""with {_SPLIT} select lx.sample_id, time, event, feature_id,
  round((x - mu) / sd, 5) as x from lx join sel using (feature_id)
  join rs on rs.sample_id = lx.sample_id where not lx.is_test""")
def export_bundle(spark, sf_dir):
    """The train tables of a written bundle, read back."""
    made = E.prepare_export(_cohort(spark, sf_dir), _matrix(spark, sf_dir), TOP, SHARE, SEED)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    sinks.write_export(made, folder)
    x = spark.read.parquet(f"{folder}/X_train.parquet")
    y = spark.read.parquet(f"{folder}/y_train.parquet").select("sample_id", "time", "event")
    return _long(x).join(y, "sample_id")


@query("one_sample_per_case", f"""with {A.SHEET_SQL}, {A.PROFILE_SQL},
t as (select sample_id, case_id, sum(value) total from profile join sheet using (sample_id)
  group by 1, 2)
select sample_id, case_id, tissue_type, is_tumor from sheet where sample_id in (select sample_id
  from t qualify row_number() over (partition by case_id order by total desc, sample_id) = 1)""")
def one_sample_per_case(spark, sf_dir):
    return E.one_sample_per_case(A.sample_sheet(spark, sf_dir), A.order_profile(spark, sf_dir))


@query("matrix_manifest", f"""with {A.EXPRESSION_SQL},
h as (select sha256(feature_id || chr(9) || sample_id || chr(9) || value::double::varchar) h
  from expr),
d as (select count(*) n, sum(('0x' || substr(h, 1, 8))::bigint)::varchar a,
  sum(('0x' || substr(h, 9, 8))::bigint)::varchar b, sum(('0x' || substr(h, 17, 8))::bigint)::varchar c,
  sum(('0x' || substr(h, 25, 8))::bigint)::varchar e from h),
hs as (select sha256(sample_id::varchar) h from (select distinct sample_id from expr)),
ds as (select count(*) n, sum(('0x' || substr(h, 1, 8))::bigint)::varchar a,
  sum(('0x' || substr(h, 9, 8))::bigint)::varchar b, sum(('0x' || substr(h, 17, 8))::bigint)::varchar c,
  sum(('0x' || substr(h, 25, 8))::bigint)::varchar e from hs)
select 'counts' as metric, ds.n as n_samples, (select count(distinct feature_id) from expr) as n_features, d.n as n_cells,
  sha256(ds.n || '-' || ds.a || '-' || ds.b || '-' || ds.c || '-' || ds.e) as samples_hash,
  sha256(d.n || '-' || d.a || '-' || d.b || '-' || d.c || '-' || d.e) as content_hash from d, ds""")
def matrix_manifest(spark, sf_dir):
    return E.matrix_manifest(A.expression(spark, sf_dir), "counts")


def _slices(what):
    """Digest of the rows ``h`` (sha256 text) of a table as ``content_digest`` forms it."""
    return f"""sha256(count(*) || '-' || {" || '-' || ".join(
        f"sum(('0x' || substr({what}, {1 + 8 * i}, 8))::bigint)::varchar" for i in range(4))})"""


def _manifest_folder(spark, cells, sources):
    path = f"{checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    sinks.write_manifest_tables(E.manifest_tables(cells, "counts", sources), path)
    return sinks.read_manifest_tables(spark, path, "features", "samples", "sources")


@query("manifest_tables", f"""with {A.EXPRESSION_SQL},
c as (select feature_id, sha256(sample_id || chr(9) || value::double::varchar) h from expr),
f as (select feature_id, count(*) as n, {_slices("h")} as digest from c group by 1)
select 'features' as "table", feature_id as id, n as n_cells, digest from f
union all select 'samples', sample_id::varchar, null, null from (select distinct sample_id from expr)
union all select 'sources', 'orders of ' || c_custkey, null, null from customer""")
def manifest_tables(spark, sf_dir):
    """Ids, source files and digests of a matrix, written as a manifest and read back."""
    sources = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("orders of "), F.col("c_custkey").cast("string")).alias("source"))
    tables = _manifest_folder(spark, A.expression(spark, sf_dir), sources)
    none = F.lit(None)
    return (tables["features"].select(F.lit("features").alias("table"), F.col("feature").alias("id"), "n_cells", "digest")
            .unionByName(tables["samples"].select(F.lit("samples").alias("table"), F.col("sample_id").cast("string").alias("id"),
                                                  none.cast("bigint").alias("n_cells"), none.cast("string").alias("digest")))
            .unionByName(tables["sources"].select(F.lit("sources").alias("table"), F.col("source").alias("id"),
                                                  none.cast("bigint").alias("n_cells"), none.cast("string").alias("digest"))))


@query("manifest_comparison", f"""with {A.EXPRESSION_SQL}, top as (select max(sample_id) as s from expr)
select 'features' as "table", feature_id as id, 'changed' as status, sample_id, value as before, value + 1 as after
  from expr, top where sample_id = s and feature_id = (select min(feature_id) from expr)
union all select 'features', (select max(feature_id) from expr), 'only_left', null, null, null
union all select 'sources', 'b', 'only_right', null, null, null""")
def manifest_comparison(spark, sf_dir):
    """Two builds, one with a changed cell, without a feature and with another source."""
    one = _matrix(spark, sf_dir)
    ends = one.agg(F.max("sample_id"), F.min("feature_id"), F.max("feature_id")).first()
    hit = (F.col("sample_id") == ends[0]) & (F.col("feature_id") == ends[1])
    two = one.where(F.col("feature_id") != ends[2]).withColumn("value", F.when(hit, F.col("value") + 1).otherwise(F.col("value")))
    sources = spark.createDataFrame([("a",), ("b",)], "source string")
    differences = E.compare_manifests(_manifest_folder(spark, one, sources.where("source = 'a'")), _manifest_folder(spark, two, sources))
    cells = E.changed_cells(one, two, differences).withColumnRenamed("feature_id", "id").withColumn("table", F.lit("features"))
    return differences.join(cells, ["table", "id"], "left").select("table", "id", "status", "sample_id", "before", "after")

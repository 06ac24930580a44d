"""Matrix construction and statistics on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortmill.functions.clinical import with_model_columns
from cohortmill.functions.numbers import rounded
from cohortmill.operators import components as K
from cohortmill.operators import matrix as M
from cohortmill.operators import matrix_store as MS
from cohortmill.operators import range_finder as RF
from cohortmill.operators import sketches as SK
from cohortmill.operators.filters import MIRNA, RNASEQ
from cohortmill.plans import adapters as A
from cohortmill.plans import builds
from cohortmill.plans.catalog import query
from cohortmill.plans.component_sql import component_sql
from cohortmill.session import broadcast_if_small, checkpoint_dir


def _matrix(spark, sf_dir):
    return M.stored_matrix(A.expression(spark, sf_dir))


def _embedding(spark, sf_dir):
    return A.embedding_cells(spark, sf_dir)


def _identity(c):
    return c.cast("double")


# ---- construction -------------------------------------------------------------------

def _quantification(spark, sf_dir, modality):
    """One file per order; a feature per brand; two metrics."""
    items = A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    name = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"),
                    F.lit(modality.file_suffixes[0])).alias("file_name")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        name, F.col("p_brand").alias(modality.feature_column)).agg(
        F.sum("l_quantity").alias(modality.metrics[0]),
        F.sum("l_extendedprice").alias(modality.metrics[-1]))


def _sheet(spark, sf_dir, modality):
    return A.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"),
                 F.lit(modality.file_suffixes[0])).alias("file_name"),
        F.concat_ws("-", F.col("o_custkey").cast("string"),
                    (F.col("o_orderkey") % 4).cast("string")).alias("sample_id"),
        F.col("o_orderkey").alias("position"))


def _build_sql(metric: str, order: str, where: str = "") -> str:
    return f"""with cells as (select 'f' || l_orderkey as file, l_orderkey, p_brand as feature_id,
  sum({metric}) as value from lineitem join part on p_partkey = l_partkey group by 1, 2, 3),
tot as (select file, l_orderkey, sum(value) total from cells group by 1, 2),
pick as (select file, o_custkey || '-' || (o_orderkey % 4) as sample_id from tot
  join orders on o_orderkey = l_orderkey qualify row_number() over (
  partition by o_custkey || '-' || (o_orderkey % 4) order by {order}) = 1)
select sample_id, feature_id, round(value, 2) as value from cells join pick using (file) {where}"""


@query("matrix_build_deepest", _build_sql("l_quantity", "total desc, file"))
def matrix_build_deepest(spark, sf_dir):
    return M.build_matrix(_quantification(spark, sf_dir, RNASEQ), _sheet(spark, sf_dir, RNASEQ),
                          "counts", "deepest", complete=False).withColumn("value", rounded(F.col("value"), 2))


@query("matrix_upkeep", _build_sql("l_quantity", "total desc, file"))
def matrix_upkeep(spark, sf_dir):
    """The matrix of the deepest files, from a third of the files, to which the others are added."""
    quant, sheet = _quantification(spark, sf_dir, RNASEQ), _sheet(spark, sf_dir, RNASEQ)
    path = f"{checkpoint_dir(spark).rstrip('/')}/matrix-{uuid.uuid4().hex}"
    third = F.pmod(F.xxhash64("file_name"), F.lit(3))
    MS.create(MS.sample_cells(quant.where(third == 0), sheet, "counts", "deepest"), path)
    for rest in (1, 2):
        MS.add(MS.sample_cells(quant.where(third == rest), sheet, "counts", "deepest"), path, "deepest")
    return MS.stored_cells(spark, path).withColumn("value", rounded(F.col("value"), 2))


@query("matrix_build_by_biotype", _build_sql(
    "l_quantity", "file", "where feature_id in (select p_brand from part group by 1 "
    "having max(p_size) = 50 and min(p_type) = 'ECONOMY')"))
def matrix_build_by_biotype(spark, sf_dir):
    features = A.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature_id")).agg(
        F.when((F.max("p_size") == 50) & (F.min("p_type") == "ECONOMY"), "protein_coding")
        .otherwise("lncRNA").alias("gene_type"))
    return M.build_matrix(
        _quantification(spark, sf_dir, RNASEQ), _sheet(spark, sf_dir, RNASEQ), "counts", "first",
        biotype="protein_coding", features=features, complete=False,
    ).withColumn("value", rounded(F.col("value"), 2))


@query("matrix_build_mirna", _build_sql("l_extendedprice", "round(total, 2) desc, file"))
def matrix_build_mirna(spark, sf_dir):
    quant = _quantification(spark, sf_dir, MIRNA)
    exact = F.round(F.col(MIRNA.default_metric).cast("decimal(18,4)"), 2)
    return M.build_matrix(
        quant.withColumn(MIRNA.default_metric, exact), _sheet(spark, sf_dir, MIRNA), None, "deepest",
        modality=MIRNA, complete=False).withColumn("value", rounded(F.col("value"), 2))


@query("matrix_build_complete", f"""with {A.EXPRESSION_SQL},
cells as (select 'f' || sample_id as file, feature_id, value from expr),
tot as (select sample_id as customer, sum(value) as total from expr group by 1),
pick as (select 'f' || customer as file, 's' || (customer // 2) as sample_id from tot
  qualify row_number() over (partition by customer // 2 order by total desc, 'f' || customer) = 1)
select sample_id, feature_id, round(value, 2) as value from cells join pick using (file)""")
def matrix_build_complete(spark, sf_dir):
    """A file per customer that holds every brand, two customers a sample; checked when built."""
    name = F.concat(F.lit("f"), F.col("key").cast("string"), F.lit(RNASEQ.file_suffixes[0])).alias("file_name")
    quant = A.expression(spark, sf_dir).withColumnRenamed("sample_id", "key").select(
        name, F.col("feature_id").alias(RNASEQ.feature_column), F.col("value").alias(RNASEQ.metrics[0]))
    sheet = A.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key").select(
        name, F.concat(F.lit("s"), F.floor(F.col("key") / 2).cast("string")).alias("sample_id"),
        F.col("key").alias("position"))
    return M.build_matrix(quant, sheet, RNASEQ.metrics[0], "deepest").withColumn(
        "value", rounded(F.col("value"), 2))


_CHECKS = """select sample_id, count(distinct feature_id) as n_features,
  count(*) - count(distinct feature_id) as n_repeated, count(*) - count(value) as n_null,
  count(*) filter (not isfinite(value::double)) as n_non_finite,
  count(distinct feature_id) = (select count(distinct feature_id) from {0}) as complete
from {0} group by 1"""


@query("matrix_checks", f"""with {A.PROFILE_SQL}
{_CHECKS.format("profile")}""")
def matrix_checks(spark, sf_dir):
    return M.matrix_checks(A.order_profile(spark, sf_dir))


@query("matrix_checks_of_lines", f"""with lines as (select l_suppkey as sample_id, p_brand as feature_id,
  case when l_discount = 0 then null when l_tax = 0 then 'inf'::double else l_quantity::double end as value
  from lineitem join part on p_partkey = l_partkey)
{_CHECKS.format("lines")}""")
def matrix_checks_of_lines(spark, sf_dir):
    """Cells as they come: repeated, empty and infinite ones in most samples."""
    items = A.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    value = F.when(F.col("l_discount") == 0, None).when(F.col("l_tax") == 0, float("inf")).otherwise(
        F.col("l_quantity").cast("double"))
    return M.matrix_checks(items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature_id"), value.alias("value")))


@query("matrix_wide", f"""with {A.EXPRESSION_SQL}
select sample_id, {', '.join(f"max(value) filter (feature_id = '{b}') as \"{b}\""
                             for b in (f"Brand#{i}" for i in range(1, 26)))} from expr group by 1""")
def matrix_wide(spark, sf_dir):
    """A column per feature of the dictionary; the SQL has to name its columns."""
    names = [r[0] for r in A.features(spark, sf_dir).orderBy("feature_id").collect()]
    return M.widen(A.expression(spark, sf_dir), names)


@query("matrix_transpose", """with c as (select n_regionkey, s_nationkey, s_acctbal from supplier
  join nation on n_nationkey = s_nationkey)
select nation, """ + ", ".join(f'sum(b) filter (r = {r}) as "r{r}"' for r in range(5)) + """
from (select 'n' || s_nationkey as nation, n_regionkey r, count(*) b from c group by 1, 2)
group by 1""")
def matrix_transpose(spark, sf_dir):
    suppliers = A.table(spark, sf_dir, "supplier").join(
        A.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nations, regions = [f"n{i}" for i in range(25)], [f"r{i}" for i in range(5)]
    wide = suppliers.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("nation"),
    ).groupBy("region").pivot("nation", nations).count()
    return M.transpose(wide, nations, regions, "region", "nation").dropna("all", subset=regions)


# ---- value distribution -------------------------------------------------------------

@query("value_distribution", f"""with {A.EXPRESSION_SQL},
dep as (select sample_id, sum(value) depth from expr group by 1)
select round(quantile_cont(value::double, 0.25), 6) as p25,
  round(quantile_cont(value::double, 0.5), 6) as median,
  round(quantile_cont(value::double, 0.75), 6) as p75, max(value) as max,
  round(100.0 * count(*) filter (value = 0) / count(*), 6) as zero_pct,
  round((select quantile_cont(depth, 0.5) from dep), 6) as median_depth, 'counts' as metric
from expr""")
def value_distribution(spark, sf_dir):
    row = M.value_distribution(_matrix(spark, sf_dir))
    return row.withColumns({c: rounded(F.col(c)) for c in
                            ("p25", "median", "p75", "max", "zero_pct", "median_depth")})


@query("metric_detection", """with d as (select l_suppkey, sum(l_extendedprice) depth, sum(l_quantity) q
  from lineitem group by 1), m as (select quantile_cont(depth, 0.5) a, quantile_cont(q, 0.5) b from d),
f as (select l_extendedprice v, l_quantity w from lineitem)
select 'price' as measure, case when (select a between 900000 and 1100000 from m) then 'TPM'
  when (select bool_and(abs(v - round(v)) <= 1e-8 + 1e-5 * abs(round(v))) from f) then 'counts'
  else 'FPKM/other' end as metric
union all select 'quantity', case when (select b between 900000 and 1100000 from m) then 'TPM'
  when (select bool_and(abs(w - round(w)) <= 1e-8 + 1e-5 * abs(round(w))) from f) then 'counts'
  else 'FPKM/other' end""")
def metric_detection(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem")

    def one(measure, column):
        cells = items.select(F.col("l_suppkey").alias("sample_id"),
                             F.col("l_partkey").alias("feature_id"), F.col(column).alias("value"))
        return M.value_distribution(cells).select(F.lit(measure).alias("measure"), "metric")

    return one("price", "l_extendedprice").unionByName(one("quantity", "l_quantity"))


@query("depth_outliers", f"""with {A.EXPRESSION_SQL},
dep as (select sample_id, sum(value) depth from expr group by 1),
m as (select quantile_cont(depth, 0.5) m from dep)
select sample_id, depth, round(depth / m - 1, 6) as deviation from dep, m
where abs(depth - m) / m > 0.05""")
def depth_outliers(spark, sf_dir):
    depths = M.aggregates.sample_depth(_matrix(spark, sf_dir))
    return M.depth_outliers(depths).withColumn("deviation", rounded(F.col("deviation")))


@query("histogram_log2", f"""with {A.EXPRESSION_SQL}, x as (select log2(value + 1) x from expr),
e as (select min(x) lo, (max(x) - min(x)) / 80 w from x),
b as (select least(floor((x - lo) / w), 79)::int bin, lo, w from x, e)
select bin, count(*) as n, round(min(lo + bin * w), 6) as bin_from,
  round(min(lo + (bin + 1) * w), 6) as bin_to from b group by 1""")
def histogram_log2(spark, sf_dir):
    return M.histogram(_matrix(spark, sf_dir)).withColumns(
        {c: rounded(F.col(c)) for c in ("bin_from", "bin_to")})


@query("histogram_per_feature_capped", f"""with {A.EXPRESSION_SQL},
x as (select feature_id, value x from expr where value <= 50),
e as (select feature_id, min(x) lo, (max(x) - min(x)) / 20 w from x group by 1),
b as (select x.feature_id, least(floor((x - lo) / w), 19)::int bin, lo, w from x
  join e on e.feature_id = x.feature_id)
select feature_id, bin, count(*) as n, round(min(lo + bin * w), 6) as bin_from,
  round(min(lo + (bin + 1) * w), 6) as bin_to from b group by 1, 2""")
def histogram_per_feature_capped(spark, sf_dir):
    counts = M.histogram(_matrix(spark, sf_dir), 20, keys=["feature_id"], transform=_identity,
                         cap=50.0)
    return counts.withColumns({c: rounded(F.col(c)) for c in ("bin_from", "bin_to")})


@query("capped_share", f"""with {A.EXPRESSION_SQL}
select cap, count(*) filter (value <= cap) as n_shown,
  round(100.0 * count(*) filter (value <= cap) / count(*), 6) as pct_shown
from expr, (values (50.0::double), (5.0::double)) c(cap) group by 1""")
def capped_share(spark, sf_dir):
    return M.capped_share(A.expression(spark, sf_dir)).withColumn(
        "pct_shown", rounded(F.col("pct_shown")))


# ---- feature statistics -------------------------------------------------------------

_STATS = f"""{A.EXPRESSION_SQL}, fs as (select feature_id, count(*) n, avg(log2(value + 1)) mean,
  var_pop(log2(value + 1)) variance, stddev_pop(log2(value + 1)) sd from expr group by 1)"""


@query("feature_statistics", f"""with {_STATS} select feature_id, n, round(mean, 6) as mean,
  round(variance, 6) as variance, round(sd, 6) as sd from fs""")
def feature_statistics(spark, sf_dir):
    return M.feature_statistics(A.expression(spark, sf_dir)).withColumns(
        {c: rounded(F.col(c)) for c in ("mean", "variance", "sd")})


@query("sketched_quantiles", f"""with {_STATS} select feature_id, n, true as q25_within, true as median_within,
  true as q99_within from fs""")
def sketched_quantiles(spark, sf_dir):
    """Quantiles from sketches of three batches of samples, each held against the exact ranks: the
    share of cells below it is at most, and that up to it at least, the wanted one, but for the
    stated error."""
    cells = _matrix(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    for batch in range(3):
        SK.add_sketches(cells.where(F.pmod(F.xxhash64("sample_id"), F.lit(3)) == batch), path, ["feature_id"], str(batch))
    points = {"q25": 0.25, "median": 0.5, "q99": 0.99}
    found = SK.sketch_quantiles(SK.stored_sketches(spark, path), ["feature_id"], points)
    met = cells.join(broadcast_if_small(found), "feature_id")
    shares = [f(F.when(F.col("value") <= F.col(p) if upto else F.col("value") < F.col(p), 1).otherwise(0)).alias(f"{p}_{upto}")
              for p in points for upto, f in ((0, F.avg), (1, F.avg))]
    counted = met.groupBy("feature_id", "n").agg(*shares)
    return counted.select("feature_id", "n", *[
        ((F.col(f"{p}_0") <= share + SK.rank_error()) & (F.col(f"{p}_1") >= share - SK.rank_error())).alias(f"{p}_within")
        for p, share in points.items()])


@query("variance_thresholds", f"""with {_STATS}
select threshold, count(*) filter (variance > threshold) as n_above,
  round(100.0 * count(*) filter (variance > threshold) / count(*), 6) as pct_above
from fs, (values (0.1::double), (0.5::double), (1.0::double), (2.0::double)) t(threshold)
group by 1""")
def variance_thresholds(spark, sf_dir):
    stats = M.feature_statistics(A.expression(spark, sf_dir))
    return M.variance_thresholds(stats).withColumn("pct_above", rounded(F.col("pct_above")))


@query("top_variance_features", f"""with {_STATS} select feature_id, round(variance, 6) as variance,
  round(mean, 6) as mean from fs order by fs.variance desc, feature_id limit 10""")
def top_variance_features(spark, sf_dir):
    stats = M.feature_statistics(A.expression(spark, sf_dir))
    return M.top_by_variance(stats, 10).select(
        "feature_id", rounded(F.col("variance")).alias("variance"),
        rounded(F.col("mean")).alias("mean"))


@query("z_scores", f"""with {_STATS} select sample_id, feature_id, value,
  round((log2(value + 1) - mean) / case when sd = 0 then 1 else sd end, 5) as z
from expr join fs using (feature_id)""")
def z_scores(spark, sf_dir):
    cells = _matrix(spark, sf_dir)
    return M.z_scores(cells, M.feature_statistics(cells)).withColumn("z", rounded(F.col("z"), 5))


@query("eta_squared", f"""with {A.EMBEDDING_SQL},
g as (select feature_id, label, count(*) n, avg(value) m from emb group by 1, 2),
t as (select feature_id, count(*) n, avg(value) m, var_pop(value) * count(*) sst from emb group by 1)
select t.feature_id, t.n, round(sum(g.n * pow(g.m - t.m, 2)) / nullif(t.sst, 0), 6) as eta_squared
from g join t on t.feature_id = g.feature_id group by t.feature_id, t.n, t.sst""")
def eta_squared(spark, sf_dir):
    return M.eta_squared(_embedding(spark, sf_dir), "value", "label", ["feature_id"]).withColumn(
        "eta_squared", rounded(F.col("eta_squared")))


@query("eta_squared_of_depth", f"""with {A.COHORT_SQL}, {A.EXPRESSION_SQL},
d as (select sample_id, sum(value) depth from expr group by 1),
r as (select depth, site from d join coh using (sample_id)),
g as (select site, count(*) n, avg(depth) m from r group by 1)
select (select count(*) from r) as n, round(sum(n * pow(m - (select avg(depth) from r), 2)) /
  (select var_pop(depth) * count(*) from r), 6) as eta_squared from g""")
def eta_squared_of_depth(spark, sf_dir):
    depths = M.aggregates.sample_depth(A.expression(spark, sf_dir))
    rows = depths.join(A.cohort(spark, sf_dir).select("sample_id", "site"), "sample_id")
    return M.eta_squared(rows, "depth", "site").withColumn(
        "eta_squared", rounded(F.col("eta_squared")))


_NAMES = "(values ('M1', 'Brand#1'), ('M2', 'Brand#12'), ('M3', 'Brand#25'), ('ABSENT', 'Brand#99')) n(symbol, base)"


@query("marker_summary", f"""with {A.EXPRESSION_SQL}, q as (select feature_id,
  quantile_cont(value::double, 0.5) a, quantile_cont(log2(value + 1), 0.5) b from expr group by 1)
select symbol, base, feature_id, feature_id is not null as found, round(a, 6) as median,
  round(b, 6) as median_log2 from {_NAMES} left join q on feature_id = base""")
def marker_summary(spark, sf_dir):
    return M.marker_summary(_matrix(spark, sf_dir), A.MARKERS).withColumns(
        {c: rounded(F.col(c)) for c in ("median", "median_log2")})


@query("marker_boxes", f"""with {A.COHORT_SQL}, {A.EXPRESSION_SQL},
x as (select symbol, stage_group, log2(value + 1) v from expr join {_NAMES} on feature_id = base
  join coh using (sample_id))
select symbol, stage_group, count(*) as n, round(min(v), 6) as low,
  round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median,
  round(quantile_cont(v, 0.75), 6) as q3, round(max(v), 6) as high from x group by 1, 2""")
def marker_boxes(spark, sf_dir):
    groups = with_model_columns(A.cohort(spark, sf_dir)).select("sample_id", "stage_group")
    cells = _matrix(spark, sf_dir).join(groups, "sample_id")
    return M.marker_boxes(cells, A.MARKERS, "stage_group").withColumns(
        {c: rounded(F.col(c)) for c in ("low", "q1", "median", "q3", "high")})


@query("metric_comparison", """with c as (select l_suppkey s, p_brand f, sum(l_quantity) q,
  sum(l_extendedprice) p from lineitem join part on p_partkey = l_partkey group by 1, 2)
select a.f as feature_id, 'name of ' || a.f as feature_name, a.q as counts_first,
  b.q as counts_second, round(a.p, 2) as other_first, round(b.p, 2) as other_second,
  round(a.q / b.q, 6) as ratio_counts, round(a.p / b.p, 6) as ratio_other
from c a join c b on a.f = b.f and a.s = 3 and b.s = 4""")
def metric_comparison(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem").join(
        A.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))

    def cells(column):
        return items.groupBy(F.col("l_suppkey").alias("sample_id"),
                             F.col("p_brand").alias("feature_id")).agg(F.sum(column).alias("value"))

    names = A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature_id")).distinct()
    names = names.withColumn("feature_name", F.concat(F.lit("name of "), "feature_id"))
    out = M.metric_comparison(cells("l_quantity"), cells("l_extendedprice"), names, 3, 4)
    return out.withColumns({c: rounded(F.col(c), 2) for c in ("other_first", "other_second")} | {
        c: rounded(F.col(c)) for c in ("ratio_counts", "ratio_other")})


@query("biotype_distribution", """select p_type as gene_type, count(*) as n,
  round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from part group by 1""")
def biotype_distribution(spark, sf_dir):
    features = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("gene_type"))
    return M.biotype_distribution(features).withColumn("pct", rounded(F.col("pct")))


@query("site_distribution", f"""with {A.BARCODE_SQL}, s as (select distinct barcode from bar),
c as (select case when upper(split_part(barcode, '-', 1)) = 'TCGA'
  then split_part(barcode, '-', 2) else '?' end as site from s)
select site, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct,
  count(*) >= 10 as at_least_10, count(*) <= 2 as at_most_2 from c group by 1""")
def site_distribution(spark, sf_dir):
    samples = A.barcodes(spark, sf_dir).select(F.col("barcode").alias("sample_id"))
    return M.site_distribution(samples).withColumn("pct", rounded(F.col("pct")))


# ---- ranks and components -----------------------------------------------------------

@query("feature_ranks", f"""with {A.EXPRESSION_SQL}
select feature_id, sample_id, value, row_number() over (partition by feature_id
  order by value, sample_id) as rank from expr""")
def feature_ranks(spark, sf_dir):
    return M.feature_ranks(_matrix(spark, sf_dir))


@query("rank_correlation", f"""with {_STATS},
top as (select feature_id from fs order by variance desc, feature_id limit 10),
r as (select feature_id, sample_id, row_number() over (partition by feature_id
  order by value, sample_id)::double rk from expr where feature_id in (select feature_id from top))
select a.feature_id as feature_a, b.feature_id as feature_b, round(corr(a.rk, b.rk), 6) as rho
from r a join r b on a.sample_id = b.sample_id group by 1, 2""")
def rank_correlation(spark, sf_dir):
    return K.rank_correlation(_matrix(spark, sf_dir), 10).withColumn("rho", rounded(F.col("rho")))


_SPARSE = "case when value > 60 then value else 0 end"


@query("feature_ranks_average", f"""with {A.EXPRESSION_SQL}, v as (select feature_id, sample_id, {_SPARSE} as value from expr)
select feature_id, sample_id, value, rank() over (partition by feature_id order by value)
  + (count(*) over (partition by feature_id, value) - 1) / 2 as rank from v""")
def feature_ranks_average(spark, sf_dir):
    """Ranks of a matrix that is mostly zeros; ties share the mean of their ranks."""
    return M.feature_ranks(_sparse(spark, sf_dir), ties="average")


def _sparse(spark, sf_dir):
    return M.stored_matrix(A.expression(spark, sf_dir).withColumn(
        "value", F.when(F.col("value") > 60, F.col("value")).otherwise(0.0)))


@query("rank_correlation_average", f"""with {A.EXPRESSION_SQL}, v as (select feature_id, sample_id, {_SPARSE} as value from expr),
fs as (select feature_id, var_pop(log2(value + 1)) as variance from v group by 1),
top as (select feature_id from fs order by variance desc, feature_id limit 10),
r as (select feature_id, sample_id, rank() over (partition by feature_id order by value)
  + (count(*) over (partition by feature_id, value) - 1) / 2 as rk from v where feature_id in (select feature_id from top))
select a.feature_id as feature_a, b.feature_id as feature_b, round(corr(a.rk, b.rk), 6) as rho
from r a join r b on a.sample_id = b.sample_id group by 1, 2""")
def rank_correlation_average(spark, sf_dir):
    return K.rank_correlation(_sparse(spark, sf_dir), 10, ties="average").withColumn("rho", rounded(F.col("rho")))


@query("standardized_covariance", f"""with {A.EMBEDDING_SQL},
st as (select feature_id, avg(value) mu, stddev_pop(value) sd, var_pop(value) v from emb group by 1),
top as (select feature_id, mu, sd from st order by v desc, feature_id limit 16),
z as (select sample_id, feature_id, (value - mu) / sd z from emb join top using (feature_id))
select a.feature_id as feature_a, b.feature_id as feature_b, round(avg(a.z * b.z), 5) as covariance
from z a join z b on a.sample_id = b.sample_id group by 1, 2""")
def standardized_covariance(spark, sf_dir):
    return K.covariance_cells(_embedding(spark, sf_dir), 16, transform=_identity).withColumn(
        "covariance", rounded(F.col("covariance"), 5))


@query("pca_variance", f"""with {A.EMBEDDING_SQL},
st as (select feature_id, avg(value) mu, stddev_pop(value) sd from emb group by 1),
z as (select sample_id, feature_id, (value - mu) / sd z from emb join st using (feature_id)),
c as (select a.feature_id i, b.feature_id j, avg(a.z * b.z) c from z a join z b
  on a.sample_id = b.sample_id group by 1, 2)
select 64::bigint as n_components, 100.0::double as total_pct,
  round(10000 * sum(c * c) / (64 * 64), 5) as sum_of_squares from c""")
def pca_variance(spark, sf_dir):
    """All components: the shares add up, and their squares to the squared covariance."""
    variance, _ = K.pca(_embedding(spark, sf_dir), 64, 64, transform=_identity)
    share = F.col("var_pct")
    return variance.agg(F.count("*").alias("n_components"),
                        rounded(F.sum(share)).alias("total_pct"),
                        rounded(F.sum(share * share), 5).alias("sum_of_squares"))


def _deflation_sql(components: int, steps: int) -> str:
    """Power iteration on matrix c1(m) with deflation; gives e{k}(v, l) per component."""
    parts = []
    for k in range(1, components + 1):
        parts.append(f"""i{k} as (select 0 as k, [cos(x * {k}.7) for x in range(len(m))] as v
    from c{k}
  union all select k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) from (
    select i{k}.k, list_transform(m, lambda r: list_dot_product(r, v)) as w from i{k}, c{k}
    where i{k}.k < {steps})),
e{k} as (select v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) as l
  from i{k}, c{k} where k = {steps}),
c{k + 1} as (select [[m[a][b] - l * v[a] * v[b] for b in range(1, len(m) + 1)]
  for a in range(1, len(m) + 1)] as m from c{k}, e{k})""")
    return ",\n".join(parts)


@query("pca_leading_shares", f"""with recursive {A.EMBEDDING_SQL},
st as (select feature_id, avg(value) mu, stddev_pop(value) sd from emb group by 1),
z as (select sample_id, feature_id, (value - mu) / sd z from emb join st using (feature_id)),
cc as (select a.feature_id i, b.feature_id j, avg(a.z * b.z) c from z a join z b
  on a.sample_id = b.sample_id group by 1, 2),
cr as (select i, list(c order by j) r from cc group by 1),
c1 as (select list(r order by i) m from cr),
{_deflation_sql(2, 600)}
select 1 as pc, round(100 * l / 64, 4) as var_pct from e1
union all select 2, round(100 * l / 64, 4) from e2""")
def pca_leading_shares(spark, sf_dir):
    variance, _ = K.pca(_embedding(spark, sf_dir), 2, 64, transform=_identity)
    return variance.select("pc", rounded(F.col("var_pct"), 4).alias("var_pct"))


@query("pca_components", f"""with recursive {A.EXPRESSION_SQL}, {component_sql(5)},
sh as ({' union all '.join(f"select {k} as pc, l from e{k}" for k in range(1, 6))})
select pc, round(l, 4) as var_pct, round(sum(l) over (order by pc), 4) as cum_pct from sh""")
def pca_components(spark, sf_dir):
    return K.pca(_matrix(spark, sf_dir), 5)[0].select(
        "pc", *[rounded(F.col(c), 4).alias(c) for c in ("var_pct", "cum_pct")])


@query("pca_range_finder", f"""with recursive {A.EXPRESSION_SQL}, {component_sql(5)},
sh as ({' union all '.join(f"select {k} as pc, l from e{k}" for k in range(1, 6))})
select pc, round(l, 4) as var_pct, round(sum(l) over (order by pc), 4) as cum_pct from sh""")
def pca_range_finder(spark, sf_dir):
    """The same shares without a covariance matrix."""
    vectors, _ = K.standardized_vectors(_matrix(spark, sf_dir))
    return RF.leading_components(vectors, 5)[0].select(
        "pc", *[rounded(F.col(c), 4).alias(c) for c in ("var_pct", "cum_pct")])


@query("pca_range_finder_scores", f"""with recursive {A.EXPRESSION_SQL}, {component_sql(2)}
select sample_id, round(list_dot_product(z, e1.v), 4) as pc1, round(list_dot_product(z, e2.v), 4) as pc2
from pz, e1, e2""")
def pca_range_finder_scores(spark, sf_dir):
    vectors, _ = K.standardized_vectors(_matrix(spark, sf_dir))
    return RF.leading_components(vectors, 2, oversample=30)[1].select(
        "sample_id", *[rounded(F.col(c), 4).alias(c) for c in ("pc1", "pc2")])


@query("pca_scores_with_metadata", f"""with recursive {A.COHORT_SQL}, {A.EXPRESSION_SQL}, {component_sql(2)},
big as (select site from coh group by 1 order by count(*) desc, site limit 8)
select sample_id, round(list_dot_product(z, e1.v), 4) as pc1, round(list_dot_product(z, e2.v), 4) as pc2,
  event, gender, ajcc_pathologic_stage, site,
  case when site in (select site from big) then site::varchar else 'other' end as site_group
from pz join coh using (sample_id), e1, e2""")
def pca_scores_with_metadata(spark, sf_dir):
    scores = K.pca(_matrix(spark, sf_dir), 2)[1].select(
        "sample_id", *[rounded(F.col(c), 4).alias(c) for c in ("pc1", "pc2")])
    meta = A.cohort(spark, sf_dir).select(
        "sample_id", "event", "gender", "ajcc_pathologic_stage", "site")
    return K.component_overlay(scores, meta)


# ---- the report as one table ---------------------------------------------------------

_CODED = f"""people as (select c_custkey, 'TCGA-' || lpad(c_nationkey::varchar, 2, '0') || '-' ||
  {A.person_code_sql("c_custkey")} || '-01A' as code from customer),
expr as (select code as sample_id, feature_id, value from cust join people on c_custkey = cust.sample_id)"""


def _coded_matrix(spark, sf_dir):
    """The matrix with a barcode, site included, as sample id."""
    people = A.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample_id"),
        F.concat_ws("-", F.lit("TCGA"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
                    A.person_code(F.col("c_custkey")), F.lit("01A")).alias("code"))
    return M.stored_matrix(A.expression(spark, sf_dir).join(people, "sample_id").select(
        F.col("code").alias("sample_id"), "feature_id", "value"))


@query("matrix_summary", f"""with recursive {A.EXPRESSION_SQL.replace("expr as (", "cust as (")}, {_CODED}, {component_sql(3)},
dep as (select sample_id, sum(value) depth from expr group by 1),
md as (select feature_id, quantile_cont(value::double, 0.5) a, quantile_cont(log2(value + 1), 0.5) b from expr group by 1),
st as (select split_part(sample_id, '-', 2) site, count(distinct sample_id) n from expr group by 1)
select 'size' as part, 'n_features' as item, count(distinct feature_id)::double as value from expr
union all select 'size', 'n_samples', count(distinct sample_id) from expr
union all select 'distribution', 'p25', round(quantile_cont(value::double, 0.25), 6) from expr
union all select 'distribution', 'median', round(quantile_cont(value::double, 0.5), 6) from expr
union all select 'distribution', 'p75', round(quantile_cont(value::double, 0.75), 6) from expr
union all select 'distribution', 'max', max(value) from expr
union all select 'distribution', 'zero_pct', round(100.0 * count(*) filter (value = 0) / count(*), 6) from expr
union all select 'distribution', 'median_depth', round(quantile_cont(depth, 0.5), 6) from dep
union all select 'sites', site, n from st
union all select 'components', '1', round(l, 4) from e1
union all select 'components', '2', round(l, 4) from e2
union all select 'components', '3', round(l, 4) from e3
union all select 'markers', symbol, round(b, 6) from {_NAMES} left join md on feature_id = base""")
def matrix_summary(spark, sf_dir):
    """All parts of the matrix report, one number per row."""
    parts = builds.matrix_summary(_coded_matrix(spark, sf_dir), A.MARKERS, components=3)

    def rows(part, item, value):
        return parts[part].select(F.lit(part).alias("part"), item.cast("string").alias("item"),
                                  value.cast("double").alias("value"))

    def fields(part, *names):
        return parts[part].select(F.lit(part).alias("part"), F.inline(F.array(*[
            F.struct(F.lit(n).alias("item"), rounded(F.col(n).cast("double")).alias("value")) for n in names])))

    return (fields("size", "n_features", "n_samples")
            .unionByName(fields("distribution", "p25", "median", "p75", "max", "zero_pct", "median_depth"))
            .unionByName(rows("sites", F.col("site"), F.col("n")))
            .unionByName(rows("components", F.col("pc"), rounded(F.col("var_pct"), 4)))
            .unionByName(rows("markers", F.col("symbol"), rounded(F.col("median_log2")))))

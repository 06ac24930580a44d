"""Column functions, filters, joins, counts and quality rules on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortmill.functions import clinical as FC
from cohortmill.functions import fixed
from cohortmill.functions import identifiers as FI
from cohortmill.functions.numbers import log2p1, log2p1_clipped, rounded
from cohortmill.operators import aggregates as G
from cohortmill.operators import dedup as D
from cohortmill.operators import filters as P
from cohortmill.operators import joins as J
from cohortmill.operators import observed as OB
from cohortmill.operators import quality as Q
from cohortmill.plans import adapters as A
from cohortmill.plans import builds
from cohortmill.plans.catalog import query
from cohortmill.session import checkpoint_dir, new_table
from cohortmill.sources import bucketed as BK
from cohortmill.sources import sinks, tables


def _clinical(spark, sf_dir):
    return A.cohort(spark, sf_dir).withColumnRenamed("case_id", "case_submitter_id").drop(
        "sample_id", "tissue_type")


# ---- column functions ---------------------------------------------------------------

@query("barcode_parts", f"""with {A.BARCODE_SQL}
select o_orderkey, split_part(barcode, '-', 1) || '-' || split_part(barcode, '-', 2) || '-' ||
  split_part(barcode, '-', 3) as case_barcode,
  array_to_string(string_split(barcode, '-')[1:4], '-') as sample_barcode,
  right(array_to_string(string_split(barcode, '-')[1:4], '-'), 3) as code,
  case when upper(split_part(barcode, '-', 1)) = 'TCGA' then split_part(barcode, '-', 2)
       else '?' end as site_strict,
  split_part(barcode, '-', 2) as site_loose, substr(barcode, 6, 2) as site_slice from bar""")
def barcode_parts(spark, sf_dir):
    c = F.col("barcode")
    sample = FI.sample_barcode(c)
    return A.barcodes(spark, sf_dir).select(
        "o_orderkey", FI.case_barcode(c).alias("case_barcode"), sample.alias("sample_barcode"),
        FI.sample_code(sample).alias("code"), FI.site_code(c).alias("site_strict"),
        FI.site_code(c, strict=False).alias("site_loose"), FI.site_slice(c).alias("site_slice"))


@query("barcode_validation", f"""with {A.BARCODE_SQL},
s as (select o_orderkey, barcode, array_to_string(string_split(barcode, '-')[1:4], '-') sample,
  array_to_string(string_split(barcode, '-')[1:3], '-') person from bar)
select o_orderkey, regexp_matches(barcode,
  '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}-[0-9]{{2}}[A-Z]-[0-9]{{2}}[A-Z]-[A-Z0-9]{{4}}-[0-9]{{2}}$')
  as aliquot_ok, regexp_matches(sample, '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}-[0-9]{{2}}[A-Z]$')
  as sample_ok, regexp_matches(person, '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}$') as case_ok,
  regexp_extract(sample, '-([0-9]{{2}}[A-Z])$', 1) as code from s""")
def barcode_validation(spark, sf_dir):
    c = F.col("barcode")
    sample = FI.sample_barcode(c)
    return A.barcodes(spark, sf_dir).select(
        "o_orderkey", FI.is_aliquot_id(c).alias("aliquot_ok"),
        FI.is_sample_id(sample).alias("sample_ok"),
        FI.is_case_id(FI.case_barcode(c)).alias("case_ok"),
        FI.sample_code_strict(sample).alias("code"))


_UUID = ("lower(substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || "
         "substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || "
         "substr(md5({0}), 21, 12))")


@query("uuid_validation", f"""select c_custkey, regexp_matches(u,
  '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') as is_uuid
from (select c_custkey, case when c_acctbal < 0 then c_name
  else {_UUID.format('c_name')} end u from customer)""")
def uuid_validation(spark, sf_dir):
    u = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.expr(_UUID.format("c_name")))
    return A.table(spark, sf_dir, "customer").select("c_custkey", FI.is_uuid(u).alias("is_uuid"))


@query("tissue_of_sample_code", f"""with {A.BARCODE_SQL},
s as (select o_orderkey, case when o_orderkey % 25 = 24 then 'XYZ' else
  right(array_to_string(string_split(barcode, '-')[1:4], '-'), 3) end code from bar),
n as (select *, try_cast(left(code, 2) as int) k from s)
select o_orderkey, code,
  case when k between 1 and 9 then 'Tumor' when k between 10 and 19 then 'Normal'
       else 'Unknown' end as tissue_type,
  case when k is null then 'Unknown' when k = 1 then 'Primary Tumor'
       when k = 2 then 'Recurrent Tumor' when k between 3 and 9 then 'Tumor'
       when k between 10 and 19 then 'Solid Tissue Normal' else 'Other' end as sample_type from n""")
def tissue_of_sample_code(spark, sf_dir):
    code = F.when(F.col("o_orderkey") % 25 == 24, "XYZ").otherwise(
        FI.sample_code(FI.sample_barcode(F.col("barcode"))))
    rows = A.barcodes(spark, sf_dir).withColumn("code", code)
    return rows.select("o_orderkey", "code", FI.tissue_of_code(F.col("code")).alias("tissue_type"),
                       FI.sample_type_of_code(F.col("code")).alias("sample_type"))


@query("file_stems", """with f as (select o_orderkey, case o_orderstatus
  when 'F' then '/raw/f' || o_orderkey || '.rna_seq.augmented_star_gene_counts.tsv'
  when 'O' then 'f' || o_orderkey || '_rna_seq_augmented_star_gene_counts.tsv'
  else 'f' || o_orderkey || '.v2.txt' end file_name from orders)
select o_orderkey, file_name, case
  when file_name like '%.rna_seq.augmented_star_gene_counts.tsv' or
       file_name like '%\\_rna\\_seq\\_augmented\\_star\\_gene\\_counts.tsv' escape '\\'
  then 'f' || o_orderkey else 'f' || o_orderkey || '.v2' end as stem from f""")
def file_stems(spark, sf_dir):
    key = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    name = (F.when(F.col("o_orderstatus") == "F",
                   F.concat(F.lit("/raw/"), key, F.lit(fixed.RNA_FILE_SUFFIXES[0])))
            .when(F.col("o_orderstatus") == "O", F.concat(key, F.lit(fixed.RNA_FILE_SUFFIXES[1])))
            .otherwise(F.concat(key, F.lit(".v2.txt"))))
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", name.alias("file_name"))
    return rows.withColumn("stem", FI.file_stem(F.col("file_name")))


@query("stage_and_covariate_encoding", f"""with {A.COHORT_SQL}
select case_id, stage_group, (coalesce(gender = 'male', false))::int as gender_male,
  case stage_group when 'I' then 1 when 'II' then 2 when 'III' then 3 when 'IV' then 4 end
  as stage_numeric, round(time / 365.25, 6) as time_years from coh""")
def stage_and_covariate_encoding(spark, sf_dir):
    return FC.with_model_columns(A.cohort(spark, sf_dir)).select(
        "case_id", "stage_group", "gender_male", "stage_numeric",
        rounded(F.col("time_years")).alias("time_years"))


@query("log2_values", """select l_orderkey, l_linenumber, round(log2(l_extendedprice + 1), 6)
  as log_price, round(log2(greatest(l_quantity - 25, 0) + 1), 6) as log_clipped from lineitem""")
def log2_values(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        rounded(log2p1(F.col("l_extendedprice"))).alias("log_price"),
        rounded(log2p1_clipped(F.col("l_quantity") - 25)).alias("log_clipped"))


@query("missing_markers", """select o_orderkey,
  case when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then null else o_orderpriority end
    as priority,
  trim(case when o_orderstatus = 'P' then '' when o_orderstatus = 'O' then ''
       else ' ' || o_orderpriority || ' ' end) as canonical from orders""")
def missing_markers(spark, sf_dir):
    raw = (F.when(F.col("o_orderstatus") == "P", "'--").when(F.col("o_orderstatus") == "O", "None")
           .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))))
    return A.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        FC.null_if_marker(F.col("o_orderpriority"), ("4-NOT SPECIFIED", "5-LOW")).alias("priority"),
        FC.canonical_text(raw).alias("canonical"))


@query("lenient_numbers", """select event_id,
  case when event_type = 'error' then null else trunc(value)::bigint end as whole,
  case when event_type = 'error' then null
       else (props::json ->> 'k')::bigint end as strict_whole from events""")
def lenient_numbers(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "'--").otherwise(F.col("value").cast("string"))
    k = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    return A.table(spark, sf_dir, "events").select(
        "event_id", FC.whole_number(text).alias("whole"),
        FC.whole_number(k, via_double=False).alias("strict_whole"))


@query("versioned_feature_lookup", """with f as (select p_partkey,
  p_brand || '.' || p_size as feature_id, p_brand as base from part)
select base, min(feature_id) as feature_id, count(*) as n_rows,
  count(distinct feature_id) as n_versions from f group by 1""")
def versioned_feature_lookup(spark, sf_dir):
    rows = A.table(spark, sf_dir, "part").select(
        F.concat_ws(".", "p_brand", F.col("p_size").cast("string")).alias("feature_id"))
    per_id = rows.groupBy("feature_id").agg(F.count("*").alias("n"))
    return per_id.groupBy(FI.base_feature(F.col("feature_id")).alias("base")).agg(
        F.min("feature_id").alias("feature_id"), F.sum("n").alias("n_rows"),
        F.count("*").alias("n_versions"))


# ---- filters ------------------------------------------------------------------------

@query("follow_up_filter", f"""with {A.COHORT_SQL}
select case_id, time, event from coh where time > 0 and not (time < 1800 and not event)""")
def follow_up_filter(spark, sf_dir):
    return P.follow_up_filter(A.cohort(spark, sf_dir), 1800).select("case_id", "time", "event")


@query("removal_report", f"""with {A.COHORT_SQL}
select 'zero_time' as condition, count(*) as rows, count(distinct case_id) as cases,
  count(*) filter (event) as events from coh where time <= 0
union all select 'short_censored', count(*), count(distinct case_id), count(*) filter (event)
  from coh where time < 1800 and not event
union all select 'short_events', count(*), count(distinct case_id), count(*) filter (event)
  from coh where time < 1800 and event""")
def removal_report(spark, sf_dir):
    t = F.col("time")
    return P.removal_report(A.cohort(spark, sf_dir), {
        "zero_time": t <= 0, "short_censored": P.is_short_censored(1800),
        "short_events": (t < 1800) & F.col("event")})


_CLIN = f"""{A.SHEET_SQL}, {A.COHORT_SQL},
j as (select s.sample_id, s.case_id, s.tissue_type, s.is_tumor,
  case when ajcc_pathologic_stage = 'Stage X' then null else time end as time,
  event, age_at_index, gender, ajcc_pathologic_stage from sheet s left join coh using (case_id))"""


def _clinical_known(spark, sf_dir):
    """Clinical rows; the cases of unknown stage lack a time."""
    return _clinical(spark, sf_dir).withColumn(
        "time", F.when(F.col("ajcc_pathologic_stage") != "Stage X", F.col("time")))


_FUNNEL_SQL = f"""with {_CLIN},
l as (select j.* from j where sample_id in (select l_orderkey from lineitem)),
f as (select *, is_tumor a, is_tumor and time is not null b,
  is_tumor and time is not null and time > 0 c,
  is_tumor and time is not null and time > 0 and not (time < 1800 and not event) d from l)
select 0 as step, 'all' as name, count(*) as rows, count(distinct case_id) as cases,
  count(*) filter (event) as events from f
union all select 1, 'tumor', count(*), count(distinct case_id), count(*) filter (event)
  from f where a
union all select 2, 'time_known', count(*), count(distinct case_id), count(*) filter (event)
  from f where b
union all select 3, 'time_positive', count(*), count(distinct case_id),
  count(*) filter (event) from f where c
union all select 4, 'not_short_censored', count(*), count(distinct case_id),
  count(*) filter (event) from f where d"""


@query("build_funnel", _FUNNEL_SQL)
def build_funnel(spark, sf_dir):
    samples = A.order_profile(spark, sf_dir).select("sample_id").distinct()
    return builds.build_funnel(samples, A.sample_sheet(spark, sf_dir),
                               _clinical_known(spark, sf_dir), 1800)


@query("observed_funnel", _FUNNEL_SQL)
def observed_funnel(spark, sf_dir):
    """The funnel as it was counted while the cohort was written."""
    samples = A.order_profile(spark, sf_dir).select("sample_id").distinct()
    return OB.write_cohort(samples, A.sample_sheet(spark, sf_dir), _clinical_known(spark, sf_dir), new_table(spark, "cohort"), 1800)


_DATASET_SQL = f"""with {_CLIN}, {A.PROFILE_SQL},
kept as (select * from j where is_tumor and time > 0 and not (time < 1800 and not event)
  and sample_id in (select sample_id from profile))
select kept.sample_id, case_id, time, event, age_at_index, gender, ajcc_pathologic_stage,
  tissue_type, count(*) as n_features, round(sum(value), 4) as depth
from kept join profile using (sample_id) group by all"""


@query("bucketed_dataset", _DATASET_SQL)
def bucketed_dataset(spark, sf_dir):
    """The dataset out of tables in buckets of the sample: matrix, sheet and cohort meet bucket by bucket."""
    cells = BK.save_bucketed(A.order_profile(spark, sf_dir), "sample_id", 16)
    sheet = BK.save_bucketed(A.sample_sheet(spark, sf_dir), "sample_id", 16)
    samples = spark.table(cells).select("sample_id").distinct()
    rows = builds.survival_cohort(samples, spark.table(sheet), _clinical_known(spark, sf_dir), min_follow_up_days=1800)
    cohort = BK.save_bucketed(rows, "sample_id", 16)
    per_sample = BK.joined(cells, cohort, "sample_id", "left_semi", spark).groupBy("sample_id").agg(
        F.count("*").alias("n_features"), rounded(F.sum("value"), 4).alias("depth"))
    return spark.table(cohort).join(per_sample, "sample_id")


@query("survival_dataset", _DATASET_SQL)
def survival_dataset(spark, sf_dir):
    cohort, cells = builds.survival_dataset(
        A.order_profile(spark, sf_dir), A.sample_sheet(spark, sf_dir),
        _clinical_known(spark, sf_dir), min_follow_up_days=1800)
    per_sample = cells.groupBy("sample_id").agg(
        F.count("*").alias("n_features"), rounded(F.sum("value"), 4).alias("depth"))
    return cohort.join(per_sample, "sample_id")


@query("follow_up_outliers", f"""with {A.COHORT_SQL}
select case_id, time, event, case when time < 1500 then 'short' else 'long' end as kind
from coh where time < 1500 or time > 2300""")
def follow_up_outliers(spark, sf_dir):
    return P.follow_up_outliers(A.cohort(spark, sf_dir), 1500, 2300).select(
        "case_id", "time", "event", "kind")


@query("membership_and_prefix", """select l_orderkey, l_linenumber, l_shipmode_like
from (select l_orderkey, l_linenumber, p_name, p_brand, starts_with(p_name, 's') as
  l_shipmode_like from lineitem join part on p_partkey = l_partkey)
where p_brand not in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')""")
def membership_and_prefix(spark, sf_dir):
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    kept = P.drop_summary_rows(part, "p_brand", ("Brand#1", "Brand#2", "Brand#3", "Brand#4"))
    items = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return items.join(kept, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("p_name").startswith("s").alias("l_shipmode_like"))


@query("biotype_filter", """select l_orderkey, l_linenumber, l_quantity as value
from lineitem join part on p_partkey = l_partkey where p_type = 'ECONOMY'""")
def biotype_filter(spark, sf_dir):
    features = A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("gene_type"))
    cells = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("feature_id"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("value"))
    return P.biotype_filter(cells, features, "ECONOMY").drop("feature_id")


@query("biotype_report", """select p_type as gene_type, count(*) as n,
  round(100.0 * count(*) / sum(count(*)) over (), 6) as pct, p_type = 'ECONOMY' as kept
from part group by 1""")
def biotype_report(spark, sf_dir):
    features = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("gene_type"))
    return P.biotype_report(features, "ECONOMY").withColumn("pct", rounded(F.col("pct")))


@query("feature_subset", """select l_partkey as feature_id, count(*) as n, sum(l_quantity) as total
from lineitem where l_partkey in (select l_partkey from lineitem where l_discount = 0.1)
group by 1""")
def feature_subset(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem")
    cells = items.select(F.col("l_partkey").alias("feature_id"), F.col("l_quantity").alias("value"))
    wanted = items.where(F.col("l_discount") == 0.1).select(F.col("l_partkey").alias("feature_id"))
    return P.feature_subset(cells, wanted.distinct()).groupBy("feature_id").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))


@query("missing_features", """select c_custkey as feature_id from customer
where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def missing_features(spark, sf_dir):
    cells = A.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("feature_id"))
    wanted = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature_id"))
    return P.missing_features(cells, wanted)


_NAMED = """select case when p_type in ('ECONOMY', 'PROMO') then 'ENSG' || p_partkey
  when p_type = 'SMALL' then 'hsa-mir-' || p_partkey when p_type = 'LARGE'
  then 'hsa-let-' || p_partkey else 'x' || p_partkey end as feature_id from part"""


@query("modality_detection", f"""with f as (select distinct feature_id from ({_NAMED})),
c as (select case when starts_with(feature_id, 'ENSG') then 'rnaseq'
  when starts_with(feature_id, 'hsa-mir') or starts_with(feature_id, 'hsa-let') then 'mirna' end
  as modality, count(*) as n_features from f group by 1)
select modality, n_features, n_features = (select max(n_features) from c where modality is not null)
  as detected from c where modality is not null""")
def modality_detection(spark, sf_dir):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_type")
    name = (F.when(kind.isin("ECONOMY", "PROMO"), F.concat(F.lit("ENSG"), key))
            .when(kind == "SMALL", F.concat(F.lit("hsa-mir-"), key))
            .when(kind == "LARGE", F.concat(F.lit("hsa-let-"), key))
            .otherwise(F.concat(F.lit("x"), key)))
    return P.modality_counts(A.table(spark, sf_dir, "part").select(name.alias("feature_id")))


@query("metric_selection", """select l_orderkey, l_linenumber, l_extendedprice as value
from lineitem""")
def metric_selection(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem").withColumnsRenamed(
        {"l_quantity": "unstranded", "l_extendedprice": "tpm_unstranded"})
    return P.select_metric(items, "tpm", ["l_orderkey", "l_linenumber"])


# ---- joins --------------------------------------------------------------------------

def _file_sheet(spark, sf_dir):
    """One file per order; a customer's orders fall into four samples."""
    return A.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"),
                 F.lit(fixed.RNA_FILE_SUFFIXES[0])).alias("file_name"),
        F.concat_ws("-", F.col("o_custkey").cast("string"),
                    (F.col("o_orderkey") % 4).cast("string")).alias("sample_id"),
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("position"))


_FILE_SHEET = """fs as (select 'f' || o_orderkey as stem, o_custkey || '-' || (o_orderkey % 4)
  as sample_id, o_custkey as case_id, o_orderkey as position from orders)"""


def _stems(spark, sf_dir):
    """Files at hand: one per order with items, and one per supplier that no sheet knows."""
    items = A.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("stem"))
    extra = A.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stem"))
    return items.unionByName(extra)


_STEMS = """st as (select distinct 'f' || l_orderkey as stem from lineitem
  union select 's' || s_suppkey from supplier)"""


@query("file_to_sample_map", f"""with {_STEMS}, {_FILE_SHEET}
select st.stem, sample_id from st left join fs on fs.stem = st.stem""")
def file_to_sample_map(spark, sf_dir):
    return J.files_to_samples(_stems(spark, sf_dir).distinct(),
                              J.stem_map(_file_sheet(spark, sf_dir)))


@query("last_sheet_row_wins", """select 'p' || (l_partkey) as stem,
  arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) as sample_id from lineitem group by 1""")
def last_sheet_row_wins(spark, sf_dir):
    sheet = A.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"),
                 F.lit(fixed.RNA_FILE_SUFFIXES[1])).alias("file_name"),
        F.col("l_suppkey").alias("sample_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return J.stem_map(sheet)


@query("unmapped_files", f"""with {_STEMS}, {_FILE_SHEET}
select stem from st where stem not in (select stem from fs)""")
def unmapped_files(spark, sf_dir):
    return J.unmapped_files(_stems(spark, sf_dir), J.stem_map(_file_sheet(spark, sf_dir)))


@query("samples_with_sheet_and_clinical", f"""with {_CLIN}
select sample_id, case_id, tissue_type, time, event, age_at_index, gender,
  ajcc_pathologic_stage from j""")
def samples_with_sheet_and_clinical(spark, sf_dir):
    samples = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    rows = J.attach_sheet(samples, A.sample_sheet(spark, sf_dir))
    return J.attach_clinical(rows, _clinical_known(spark, sf_dir)).select(
        "sample_id", "case_id", "tissue_type", "time", "event", "age_at_index", "gender",
        "ajcc_pathologic_stage")


def _stale(spark, sf_dir):
    """A dataset with an empty gender and stages only for tumor samples."""
    return A.sample_sheet(spark, sf_dir).select(
        "sample_id", "case_id", F.lit(None).cast("string").alias("gender"),
        F.lit(1.0).alias("age_at_index"),
        F.when(F.col("is_tumor"), "Stage IB").alias("ajcc_pathologic_stage"), "tissue_type")


@query("refreshed_covariates", f"""with {A.SHEET_SQL}, {A.COHORT_SQL}
select s.sample_id, s.case_id, gender, age_at_index, ajcc_pathologic_stage, tissue_type
from sheet s left join (select * from coh where age_at_index >= 0) using (case_id)""")
def refreshed_covariates(spark, sf_dir):
    fresh = _clinical(spark, sf_dir).where("age_at_index >= 0")
    return J.refresh_covariates(_stale(spark, sf_dir), fresh)


_REFRESH_SQL = f"""with {A.SHEET_SQL}, {A.COHORT_SQL},
n as (select s.*, gender, age_at_index, ajcc_pathologic_stage, c.case_id is not null hit
  from sheet s left join (select * from coh where age_at_index >= 0) c on c.case_id = s.case_id),
t as (select count(*) n, count(*) filter (hit) matched from n)
select 'age_at_index' as "column", 100.0::double as pct_before,
  round((select 100.0 * count(age_at_index) / count(*) from n), 6) as pct_after, n, matched from t
union all select 'gender', 0.0,
  round((select 100.0 * count(gender) / count(*) from n), 6), n, matched from t
union all select 'ajcc_pathologic_stage',
  round((select 100.0 * count(*) filter (is_tumor) / count(*) from n), 6),
  round((select 100.0 * count(ajcc_pathologic_stage) / count(*) from n), 6), n, matched from t"""


@query("observed_refresh", _REFRESH_SQL)
def observed_refresh(spark, sf_dir):
    """The refresh report as it was counted while the refreshed table was written."""
    fresh = _clinical(spark, sf_dir).where("age_at_index >= 0")
    report = OB.write_refreshed(_stale(spark, sf_dir), fresh, new_table(spark, "refreshed"))
    return report.withColumns({c: rounded(F.col(c)) for c in ("pct_before", "pct_after")})


@query("refresh_report", _REFRESH_SQL)
def refresh_report(spark, sf_dir):
    stale = _stale(spark, sf_dir)
    fresh = _clinical(spark, sf_dir).where("age_at_index >= 0")
    report = J.refresh_report(stale, J.refresh_covariates(stale, fresh), fresh)
    return report.withColumns({c: rounded(F.col(c)) for c in ("pct_before", "pct_after")})


@query("count_comparison", """with a as (select l_suppkey k, count(*) n_left from lineitem
  where l_returnflag = 'R' group by 1), b as (select ps k, count(*) n_right from
  (select l_suppkey ps from lineitem where l_linestatus = 'O'
   union all select s_suppkey + 50 from supplier) group by 1)
select k as l_suppkey, n_left, n_right, case when n_left is null then 'only_right'
  when n_right is null then 'only_left' when n_left <> n_right then 'different'
  else 'equal' end as status from a full join b using (k)""")
def count_comparison(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem")
    left = items.where("l_returnflag = 'R'").select("l_suppkey")
    right = items.where("l_linestatus = 'O'").select("l_suppkey").unionByName(
        A.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 50).alias("l_suppkey")))
    return J.count_comparison(left, right, "l_suppkey")


def _two_sources(spark, sf_dir):
    """Orders as two portals export them: other spellings of missing, some other values."""
    rows = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("order"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    left = rows.withColumn("priority", FC.null_if_marker(F.col("priority"), ("4-NOT SPECIFIED",)))
    right = rows.withColumns({
        "priority": F.when(F.col("priority") == "4-NOT SPECIFIED", "'--").otherwise(
            F.col("priority")),
        "status": F.when((F.col("status") == "P") & (F.col("priority") == "5-LOW"), "O").otherwise(
            F.col("status"))})
    return left, right


_CELLS = """cells as (select o_custkey as case_id, row_number() over (partition by o_custkey
  order by o_orderkey::varchar) as place, 'status' as "column", o_orderstatus as left_value,
  'O' as right_value, o_orderstatus = 'P' and o_orderpriority = '5-LOW' as differs from orders)"""


@query("cell_comparison", f"""with {_CELLS}
select case_id, place, "column", left_value, right_value from cells where differs""")
def cell_comparison(spark, sf_dir):
    left, right = _two_sources(spark, sf_dir)
    return J.cell_comparison(left, right, "case_id", ["order", "priority", "status"], "order")


@query("mismatch_summary", f"""with {_CELLS}, d as (select * from cells where differs)
select "column", case_id, place, left_value, right_value,
  row_number() over (order by case_id, place)::int as example,
  (select count(*) from d) as n_diff from d
qualify row_number() over (order by case_id, place) <= 3""")
def mismatch_summary(spark, sf_dir):
    left, right = _two_sources(spark, sf_dir)
    cells = J.cell_comparison(left, right, "case_id", ["order", "priority", "status"], "order")
    return J.mismatch_summary(cells, "case_id")


@query("source_agreement", """with a as (select doc_id, lang, source, n_chars from documents),
b as (select l.doc_id, lang, case when quality = 1 then source else 'low' end source, n_chars
  from labels l join documents d on d.doc_id = l.doc_id), m as (select a.lang = b.lang x,
  a.source = b.source y, a.n_chars = b.n_chars z from a join b on a.doc_id = b.doc_id)
select 'lang' as "column", count(*) filter (x) as n_equal, count(*) as n from m
union all select 'source', count(*) filter (y), count(*) from m
union all select 'n_chars', count(*) filter (z), count(*) from m""")
def source_agreement(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labelled = A.table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", F.when(F.col("quality") == 1, F.col("source")).otherwise("low")
        .alias("source"), "n_chars")
    return J.agreement(docs, labelled, "doc_id", ["lang", "source", "n_chars"])


@query("key_difference", """select coalesce(d.doc_id, l.doc_id) as doc_id,
  case when l.doc_id is null then 'left' when d.doc_id is null then 'right' else 'both' end as side
from (select distinct doc_id from documents) d full join
     (select distinct doc_id * 2 as doc_id from labels) l on d.doc_id = l.doc_id""")
def key_difference(spark, sf_dir):
    doubled = A.table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    return J.key_difference(A.table(spark, sf_dir, "documents"), doubled, "doc_id")


@query("feature_names", """select l_orderkey, l_linenumber, l_partkey as feature_id,
  p_name as feature_name from lineitem join part on p_partkey = l_partkey""")
def feature_names(spark, sf_dir):
    cells = A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("feature_id"))
    names = A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("feature_name"))
    return J.with_feature_names(cells, names)


@query("clinical_lookup", f"""with {A.BARCODE_SQL},
s as (select o_orderkey, array_to_string(string_split(barcode, '-')[1:4], '-') sample_id,
  array_to_string(string_split(barcode, '-')[1:3], '-') person, o_orderstatus, o_totalprice
  from bar join orders using (o_orderkey)),
d as (select * from s where o_orderstatus = 'F'),
e as (select sample_id, min(o_totalprice) price from d group by 1),
f as (select person, arg_min(o_totalprice, (sample_id, o_totalprice)) price from d group by 1)
select s.o_orderkey, s.sample_id, case when e.price is not null then 'sample'
  when f.price is not null then 'case' else 'none' end as match,
  coalesce(e.price, f.price) as price
from s left join e on e.sample_id = s.sample_id left join f on f.person = s.person""")
def clinical_lookup(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    samples = A.barcodes(spark, sf_dir).select(
        "o_orderkey", FI.sample_barcode(F.col("barcode")).alias("sample_id"))
    dataset = samples.join(orders, "o_orderkey").where("o_orderstatus = 'F'").select(
        "sample_id", FI.case_barcode(F.col("sample_id")).alias("case_id"),
        F.col("o_totalprice").alias("price")).groupBy("sample_id", "case_id").agg(
        F.min("price").alias("price"))
    return J.clinical_lookup(samples, dataset, ["price"])


# ---- counts and profiles ------------------------------------------------------------

@query("value_counts", "select lang, source, count(*) as n from documents group by 1, 2")
def value_counts(spark, sf_dir):
    return G.value_counts(A.table(spark, sf_dir, "documents"), "lang", "source")


@query("unique_count", """select count(*) as n_rows, count(distinct l_partkey) as n_unique
from lineitem""")
def unique_count(spark, sf_dir):
    return G.unique_count(A.table(spark, sf_dir, "lineitem"), "l_partkey")


@query("sample_depth", """select o_custkey as sample_id, sum(l_quantity) as depth
from lineitem join orders on o_orderkey = l_orderkey group by 1""")
def sample_depth(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cells = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.sample_depth(cells, "o_custkey", "l_quantity").withColumnRenamed(
        "o_custkey", "sample_id")


@query("depth_ratio", """with d as (select l_suppkey, sum(l_quantity) depth from lineitem group by 1)
select a.depth as depth_first, b.depth as depth_second, round(a.depth / b.depth, 6) as depth_ratio
from d a, d b where a.l_suppkey = 1 and b.l_suppkey = 2""")
def depth_ratio(spark, sf_dir):
    depths = G.sample_depth(A.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")
    return G.depth_ratio(depths, 1, 2, "l_suppkey").withColumn(
        "depth_ratio", rounded(F.col("depth_ratio")))


_PROFILE = """count({0}) as n, min({0}) as min, round(quantile_cont({0}, 0.25), 6) as q25,
  round(quantile_cont({0}, 0.5), 6) as median, round(avg({0}), 5) as mean,
  round(quantile_cont({0}, 0.75), 6) as q75, max({0}) as max,
  round(100.0 * stddev_pop({0}) / avg({0}), 5) as cv_pct"""


def _profile_columns(df, *keys):
    return df.select(*keys, "n", "min", "max", *[
        rounded(F.col(c), d).alias(c) for c, d in
        (("q25", 6), ("median", 6), ("q75", 6), ("mean", 5), ("cv_pct", 5))])


@query("numeric_profile", f"select {_PROFILE.format('l_extendedprice')} from lineitem")
def numeric_profile(spark, sf_dir):
    return _profile_columns(G.numeric_profile(A.table(spark, sf_dir, "lineitem"),
                                              "l_extendedprice"))


@query("numeric_profile_by_group", f"""select event_type, {_PROFILE.format('value')}
from events group by 1""")
def numeric_profile_by_group(spark, sf_dir):
    return _profile_columns(G.numeric_profile(A.table(spark, sf_dir, "events"), "value",
                                              ["event_type"]), "event_type")


def _nearest(value, p):
    return f"list_sort(list({value}))[floor((count({value}) - 1) * {p} + 0.5)::bigint + 1]"


@query("numeric_profile_nearest", f"""select event_type, count(value) as n, min(value) as min, max(value) as max,
  {", ".join(f"round({_nearest('value', p)}, 6) as {name}" for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))},
  round(avg(value), 5) as mean, round(100.0 * stddev_pop(value) / avg(value), 5) as cv_pct from events
  where value is not null group by 1""")
def numeric_profile_nearest(spark, sf_dir):
    """Quartiles of the nearest rank."""
    events = A.table(spark, sf_dir, "events").where("value is not null")
    return _profile_columns(G.numeric_profile(events, "value", ["event_type"], nearest=True), "event_type")


@query("event_rates", f"""with {A.COHORT_SQL}
select ajcc_pathologic_stage, count(*) as n_samples, sum(event::int)::bigint as n_events,
  round(100.0 * sum(event::int) / count(*), 1) as event_rate_pct from coh group by 1""")
def event_rates(spark, sf_dir):
    return G.event_rates(A.cohort(spark, sf_dir), "ajcc_pathologic_stage")


@query("multi_sample_cases", f"""with {A.SHEET_SQL}
select case_id, sample_id, n_samples from (select case_id, sample_id,
  count(*) over (partition by case_id) as n_samples from sheet where is_tumor) where n_samples > 1""")
def multi_sample_cases(spark, sf_dir):
    return G.multi_sample_cases(A.sample_sheet(spark, sf_dir).where("is_tumor"))


@query("excess_samples", f"""with {A.SHEET_SQL}, c as (select case_id, count(*) n from sheet
  where is_tumor group by 1 having count(*) > 1)
select count(*) as n_cases, sum(n - 1)::bigint as n_excess from c""")
def excess_samples(spark, sf_dir):
    return G.excess_samples(A.sample_sheet(spark, sf_dir).where("is_tumor"))


@query("code_combinations", f"""with {A.BARCODE_SQL},
s as (select o_custkey as case_id, right(array_to_string(string_split(barcode, '-')[1:4], '-'), 3)
  as code from bar join orders using (o_orderkey)),
k as (select case_id, code, count(*) as n from s group by 1, 2),
c as (select case_id, string_agg(code || ' x' || n, ' + ' order by code) as combination from k
  group by 1 having sum(n) > 1)
select combination, count(*) as n_cases from c group by 1""")
def code_combinations(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"))
    samples = A.barcodes(spark, sf_dir).join(orders, "o_orderkey").select(
        "case_id", FI.sample_code_strict(FI.sample_barcode(F.col("barcode"))).alias("code"))
    return G.code_combinations(samples, "code")


@query("duplicate_keys", """select l_orderkey, l_linenumber, count(*) as n from lineitem
group by 1, 2 having count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return G.duplicate_keys(A.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("completeness", f"""with {_CLIN}, t as (select count(*) n, count(time) a,
  count(gender) b, count(case when ajcc_pathologic_stage = 'Stage IVA' then 1 end) c from j),
u as (select 'time' as "column", a as filled, n from t union all select 'gender', b, n from t
  union all select 'late_stage', c, n from t)
select "column", filled, n, round(100.0 * filled / n, 6) as pct,
  case when filled / n::double < 0.25 then 'error' when filled / n::double < 0.90 then 'warning'
  else 'ok' end as level from u""")
def completeness(spark, sf_dir):
    rows = J.attach_clinical(A.sample_sheet(spark, sf_dir), _clinical_known(spark, sf_dir))
    late = F.when(F.col("ajcc_pathologic_stage") == "Stage IVA", 1)
    report = G.completeness(rows.withColumn("late_stage", late), ["time", "gender", "late_stage"],
                            error_below=0.25)
    return report.withColumn("pct", rounded(F.col("pct")))


@query("cohort_summary", f"""with {A.COHORT_SQL}, {A.EXPRESSION_SQL}
select count(*) as n_samples, sum(event::int)::bigint as n_events,
  sum((not event)::int)::bigint as n_censored,
  round(100.0 * sum((not event)::int) / count(*), 6) as censoring_pct,
  round(quantile_cont(time::double, 0.5) / 365.25, 6) as median_followup_years,
  (select count(distinct feature_id) from expr) as n_features from coh""")
def cohort_summary(spark, sf_dir):
    features = A.expression(spark, sf_dir).agg(F.count_distinct("feature_id")).scalar()
    row = G.cohort_summary(A.cohort(spark, sf_dir), features)
    return row.withColumns({c: rounded(F.col(c)) for c in ("censoring_pct", "median_followup_years")})


@query("stage_counts", f"""with {A.COHORT_SQL}
select stage_group, count(*) as n from coh group by 1""")
def stage_counts(spark, sf_dir):
    return G.value_counts(FC.with_model_columns(A.cohort(spark, sf_dir)), "stage_group")


@query("composition_change", f"""with {A.SHEET_SQL}, k as (select distinct l_orderkey as sample_id
  from lineitem where l_returnflag = 'R')
select tissue_type, count(*) as n_before, count(k.sample_id) as n_after,
  count(*) - count(k.sample_id) as n_removed from sheet left join k using (sample_id) group by 1""")
def composition_change(spark, sf_dir):
    kept = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("sample_id"))
    return G.composition_change(A.sample_sheet(spark, sf_dir), kept)


@query("site_shares", f"""with {A.COHORT_SQL}
select site, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct,
  count(*) >= 10 as at_least_10, count(*) <= 2 as at_most_2 from coh group by 1""")
def site_shares(spark, sf_dir):
    return G.group_shares(A.cohort(spark, sf_dir), "site").withColumn("pct", rounded(F.col("pct")))


@query("first_per_group", """select p_type, min(p_partkey) as p_partkey,
  arg_min(p_name, p_partkey) as p_name, arg_min(p_brand, p_partkey) as p_brand
from part group by 1""")
def first_per_group(spark, sf_dir):
    return G.first_per_group(A.table(spark, sf_dir, "part"), "p_type", "p_partkey",
                             ["p_name", "p_brand"])


@query("transfer_report", """with t as (select event_type <> 'error' as verified,
  (value * 1000)::bigint as b, value as s, event_id % 3 as a from events)
select count(*) as n_files, count(*) filter (verified) as n_verified,
  count(*) filter (not verified) as n_failed, count(*) filter (a = 0) as n_skipped,
  sum(b)::bigint as total_bytes, round(sum(s), 4) as total_seconds, bool_and(verified) as all_verified,
  round(sum(b) / 1048576.0, 6) as total_mb, round(sum(b) / 1048576.0 / sum(s), 6) as mb_per_s from t""")
def transfer_report(spark, sf_dir):
    transfers = A.table(spark, sf_dir, "events").select(
        (F.col("event_type") != "error").alias("verified"),
        F.round(F.col("value") * 1000).cast("bigint").alias("bytes_downloaded"),
        F.col("value").alias("duration_s"), (F.col("event_id") % 3).alias("attempts"))
    row = G.transfer_report(transfers)
    return row.withColumns({"total_seconds": rounded(F.col("total_seconds"), 4),
                            "total_mb": rounded(F.col("total_mb")),
                            "mb_per_s": rounded(F.col("mb_per_s"))})


@query("table_profile", """with t as (select count(*) n, count(*) filter (o_orderkey is null) a,
  count(*) filter (o_custkey is null) b,
  count(*) filter (o_orderpriority = '4-NOT SPECIFIED') c from orders)
select 0 as position, 'o_orderkey' as "column", 'bigint' as type, n as n_rows, 3 as n_columns,
  a as n_null from t union all select 1, 'o_custkey', 'bigint', n, 3, b from t
union all select 2, 'priority', 'string', n, 3, c from t""")
def table_profile(spark, sf_dir):
    return G.table_profile(A.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        FC.null_if_marker(F.col("o_orderpriority"), ("4-NOT SPECIFIED",)).alias("priority")))


# ---- one row per key ----------------------------------------------------------------

@query("smallest_row_per_case", """select o_custkey, o_orderpriority, o_orderstatus, o_orderkey
from orders qualify row_number() over (partition by o_custkey
  order by o_orderpriority, o_orderstatus, o_orderkey) = 1""")
def smallest_row_per_case(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")
    return D.smallest_row_per_key(rows, "o_custkey")


_FILES = f"""{_FILE_SHEET}, tot as (select 'f' || l_orderkey as file, sum(l_quantity) as total
  from lineitem group by 1),
fl as (select file, total, sample_id from tot join fs on fs.stem = file)"""


def _file_totals(spark, sf_dir):
    files = A.table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file")).agg(
        F.sum("l_quantity").alias("total"))
    return files.join(J.stem_map(_file_sheet(spark, sf_dir)), F.col("file") == F.col("stem")).drop(
        "stem")


@query("deepest_file_per_sample", f"""with {_FILES}
select sample_id, file, total, count(*) over (partition by sample_id) as n_files from fl
qualify row_number() over (partition by sample_id order by total desc, file) = 1""")
def deepest_file_per_sample(spark, sf_dir):
    return D.chosen_files(_file_totals(spark, sf_dir), "deepest")


@query("first_file_per_sample", f"""with {_FILES}
select sample_id, file, total, count(*) over (partition by sample_id) as n_files from fl
qualify row_number() over (partition by sample_id order by file) = 1""")
def first_file_per_sample(spark, sf_dir):
    return D.chosen_files(_file_totals(spark, sf_dir), "first")


@query("deepest_sample_per_case", """with t as (select o_custkey as case_id,
  o_orderkey as sample_id, sum(l_quantity) as total from lineitem join orders
  on o_orderkey = l_orderkey group by 1, 2)
select * from t qualify row_number() over (partition by case_id order by total desc, sample_id) = 1""")
def deepest_sample_per_case(spark, sf_dir):
    items = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.sum("l_quantity").alias("total"))
    orders = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("case_id"))
    return D.deepest_sample_per_case(items.join(orders, "sample_id"))


# ---- clinical and sample-sheet jobs on raw-looking tables ----------------------------

def _raw_clinical(spark, sf_dir):
    """Orders as a raw clinical export: text columns, several rows per case."""
    orders = A.table(spark, sf_dir, "orders")
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("timestamp")).cast("string")
    dead = F.col("o_orderstatus") == "F"
    return orders.select(
        F.concat(F.lit("TCGA-44-"), A.person_code(F.col("o_custkey")))
        .alias("cases.submitter_id"),
        F.lit("Lung").alias("cases.primary_site"),
        F.when(dead, "Dead").when(F.col("o_orderstatus") == "O", "Alive").otherwise("'--")
        .alias("demographic.vital_status"),
        F.when(dead, F.concat(day, F.lit(".7"))).otherwise("'--")
        .alias("demographic.days_to_death"),
        (F.col("o_custkey") % 90).cast("string").alias("demographic.age_at_index"),
        F.when(F.col("o_custkey") % 10 == 0, "not reported").otherwise("male")
        .alias("demographic.gender"),
        F.lit("not reported").alias("demographic.race"),
        F.when(F.col("o_orderpriority") < "4", "true").otherwise("false")
        .alias("diagnoses.diagnosis_is_primary_disease"),
        F.when(dead, "'--").otherwise(day).alias("diagnoses.days_to_last_follow_up"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "--").otherwise("Stage IIA")
        .alias("diagnoses.ajcc_pathologic_stage"))


@query("clinical_job", f"""with r as (select 'TCGA-44-' || {A.person_code_sql("o_custkey")}
  as case_submitter_id, 'Lung' as primary_site,
  case o_orderstatus when 'F' then 'Dead' when 'O' then 'Alive' end as vital_status,
  case when o_orderstatus = 'F' then date_diff('day', timestamp '1995-01-01', o_orderdate) ||
    '.7' end as dd, (o_custkey % 90)::varchar as age,
  case when o_custkey % 10 <> 0 then 'male' end as gender,
  case when o_orderstatus <> 'F' then date_diff('day', timestamp '1995-01-01', o_orderdate)::varchar
    end as dl,
  case when o_orderpriority <> '3-MEDIUM' then 'Stage IIA' end as stage
  from orders where o_orderpriority < '4'),
u as (select * from r qualify row_number() over (partition by case_submitter_id
  order by primary_site nulls first, vital_status nulls first, dd nulls first, age nulls first,
  gender nulls first, dl nulls first, stage nulls first) = 1),
n as (select *, trunc(dd::double)::bigint as days_to_death, trunc(dl::double)::bigint
  as days_to_last_follow_up from u),
t as (select *, case when vital_status = 'Dead' then days_to_death else days_to_last_follow_up end
  as time from n)
select case_submitter_id, vital_status, time, vital_status = 'Dead' as event, days_to_death,
  days_to_last_follow_up, age::bigint as age_at_index, gender, null::varchar as race,
  stage as ajcc_pathologic_stage, primary_site from t where time is not null""")
def clinical_job(spark, sf_dir):
    return tables.clinical_rows(_raw_clinical(spark, sf_dir))


@query("sample_sheet_job", f"""with {A.BARCODE_SQL}, r as (select o_orderkey,
  {_UUID.format('barcode || o_orderkey')} as file_id, 'f' || o_orderkey || '.tsv' as file_name,
  array_to_string(string_split(barcode, '-')[1:3], '-') as case_id,
  array_to_string(string_split(barcode, '-')[1:4], '-') as sample_id,
  case when o_orderstatus = 'F' then 'Normal' when o_orderstatus = 'P' then 'Blood' else 'Tumor'
  end as tissue_type from bar join orders using (o_orderkey))
select file_id, file_name, case_id, sample_id, tissue_type, right(sample_id, 3)
  as tcga_sample_code, tissue_type = 'Tumor' as is_tumor,
  array_to_string(list_filter([
    case when not regexp_matches(case_id, '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}$') then 'case_id' end,
    case when not regexp_matches(sample_id, '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}-[0-9]{{2}}[A-Z]$')
      then 'sample_id' end,
    case when tissue_type not in ('Normal', 'Tumor') then 'tissue_type' end],
    lambda x: x is not null), ',') as problems from r""")
def sample_sheet_job(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    c = F.col("barcode")
    raw = A.barcodes(spark, sf_dir).join(orders, "o_orderkey").select(
        F.expr(_UUID.format("concat(barcode, o_orderkey)")).alias("File ID"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".tsv")).alias("File Name"),
        FI.case_barcode(c).alias("Case ID"), FI.sample_barcode(c).alias("Sample ID"),
        F.when(F.col("o_orderstatus") == "F", "Normal").when(F.col("o_orderstatus") == "P", "Blood")
        .otherwise("Tumor").alias("Tissue Type"))
    rows = tables.sheet_rows(raw)
    return rows.withColumn("problems", F.array_join(tables.sheet_problems(), ","))


@query("written_sample_sheet", f"""with {A.BARCODE_SQL},
r as (select o_orderkey, array_to_string(string_split(barcode, '-')[1:3], '-') as person,
  array_to_string(string_split(barcode, '-')[1:4], '-') as sample_id from bar),
n as (select *, try_cast(left(right(sample_id, 3), 2) as int) k from r)
select 'f' || o_orderkey as "File ID", 'f' || o_orderkey || '.tsv' as "File Name",
  'Gene Expression Quantification' as "Data Type", 'RNA-Seq' as "Data Category",
  'TCGA-DEMO' as "Project ID", person as "Case ID", sample_id as "Sample ID",
  case when k between 1 and 9 then 'Tumor' when k between 10 and 19 then 'Normal'
    else 'Unknown' end as "Tissue Type",
  case when k is null then 'Unknown' when k = 1 then 'Primary Tumor'
    when k = 2 then 'Recurrent Tumor' when k between 3 and 9 then 'Tumor'
    when k between 10 and 19 then 'Solid Tissue Normal' else 'Other' end as "Sample Type" from n""")
def written_sample_sheet(spark, sf_dir):
    c = F.col("barcode")
    metadata = A.barcodes(spark, sf_dir).select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_id"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".tsv")).alias("file_name"),
        F.lit("Gene Expression Quantification").alias("data_type"),
        F.lit("RNA-Seq").alias("experimental_strategy"),
        FI.case_barcode(c).alias("case_submitter_id"), FI.sample_barcode(c).alias("sample_id"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/sheet-{uuid.uuid4().hex}"
    sheet = tables.sheet_from_metadata(metadata, "TCGA-DEMO")
    sinks.write_text_table(sheet, path)
    return spark.read.schema(sheet.schema).option("sep", "\t").option("header", True).option(
        "quote", "").csv(path)


# ---- quality rules ------------------------------------------------------------------

_QC = f"""{_FILE_SHEET}, {_STEMS}, kc as (select c_custkey from customer where c_acctbal >= 0),
issues as (
  select 'error' severity, 'missing_star_file' category, sample_id, stem, null::varchar case_id,
    null::bigint n, 'Sample ' || sample_id || ' has no data file (stem: ' || stem || ')' message
    from fs where stem not in (select stem from st)
  union all select 'warning', 'orphan_star_file', null, stem, null, null,
    'Data file without a sample sheet row (stem: ' || stem || ')' from st
    where stem not in (select stem from fs)
  union all select 'error', 'missing_clinical', sample_id, null, case_id::varchar, null,
    'Case ' || case_id || ' (sample ' || sample_id || ') has no clinical data' from fs
    where case_id not in (select c_custkey from kc)
  union all select 'warning', 'duplicate_sample', sample_id, null, null, count(*),
    'Sample ' || sample_id || ' occurs ' || count(*) || ' times' from fs
    group by sample_id having count(*) > 1)"""


def _issues(spark, sf_dir):
    clinical = A.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("case_submitter_id"))
    return Q.cohort_issues(_file_sheet(spark, sf_dir), clinical, _stems(spark, sf_dir))


@query("quality_issues", f"""with {_QC} select severity, category, message, sample_id,
  stem as file_stem, case_id, n::varchar as "count" from issues""")
def quality_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select("severity", "category", "message", *[
        F.try_element_at("context", F.lit(k)).alias(k)
        for k in ("sample_id", "file_stem", "case_id", "count")])


@query("quality_report_file", f"""with {_QC} select severity, category, message, sample_id,
  case_id from issues""")
def quality_report_file(spark, sf_dir):
    """The issue report as JSON, read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/issues-{uuid.uuid4().hex}"
    sinks.write_issue_report(_issues(spark, sf_dir), path)
    return spark.read.schema(
        "severity string, category string, message string, context map<string,string>"
    ).json(path).select("severity", "category", "message", *[
        F.try_element_at("context", F.lit(k)).alias(k) for k in ("sample_id", "case_id")])


@query("quality_counts", f"""with {_QC}
select severity, category, count(*) as n from issues group by 1, 2""")
def quality_counts(spark, sf_dir):
    return Q.issue_counts(_issues(spark, sf_dir))


@query("quality_summary", f"""with {_QC} select count(*) as total,
  count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings,
  count(*) filter (severity = 'info') as info from issues""")
def quality_summary(spark, sf_dir):
    return Q.issue_summary(_issues(spark, sf_dir))


@query("quality_triage", f"""with {_QC} select category, count(*) as n,
  category <> 'missing_star_file' as handled from issues group by 1""")
def quality_triage(spark, sf_dir):
    return Q.triage(_issues(spark, sf_dir)).select("category", "n", "handled")


@query("quality_verdict", f"""with {_QC} select count(*) as total,
  count(*) filter (category <> 'missing_star_file') as n_handled,
  count(*) filter (category = 'missing_star_file') as n_action,
  case when count(*) filter (category = 'missing_star_file') > 0 then 'warn' else 'ok' end as level
from issues""")
def quality_verdict(spark, sf_dir):
    return Q.verdict(_issues(spark, sf_dir))


@query("missing_survival", f"""with {_CLIN}
select distinct 'warning' as severity, 'missing_survival' as category,
  'Case ' || case_id || ' has no follow-up time or status' as message from j where time is null""")
def missing_survival(spark, sf_dir):
    return Q.cases_without_survival(_clinical_known(spark, sf_dir)).select(
        "severity", "category", "message")


@query("low_mapped_reads", """select event_id, round(value * 100000 * ((props::json ->> 'k')::int
  / 100.0), 3) as mapped_reads from events
where value * 100000 * ((props::json ->> 'k')::int / 100.0) < 1000000""")
def low_mapped_reads(spark, sf_dir):
    metadata = A.table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") * 100000).alias("total_reads"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("proportion_reads_mapped"))
    return Q.low_mapped_reads(metadata).select(
        "event_id", rounded(F.col("mapped_reads"), 3).alias("mapped_reads"))

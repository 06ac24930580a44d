"""Views that read the given tables as cohort, sample sheet, matrix and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# five market segments read as tumour stages, one of them unknown
STAGE_OF_SEGMENT = {
    "AUTOMOBILE": "Stage IA", "BUILDING": "Stage IIB", "FURNITURE": "Stage IIIA",
    "HOUSEHOLD": "Stage IVA", "MACHINERY": "Stage X",
}
# seven brands stand for a signed gene panel
PANEL = {f"F{i}": (f"Brand#{i}", -1 if i <= 3 else 1) for i in range(1, 8)}
MARKERS = {"M1": "Brand#1", "M2": "Brand#12", "M3": "Brand#25", "ABSENT": "Brand#99"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person_code(key: Column) -> Column:
    """A key in base 36, at least four characters: no two keys share a code."""
    digits = F.conv(key.cast("string"), 10, 36)
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))


def person_code_sql(key: str) -> str:
    digits = " || ".join(f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({key} // {36 ** k} % 36)::int + 1, 1)"
                         for k in range(11, -1, -1))
    return f"lpad(ltrim({digits}, '0'), greatest(length(ltrim({digits}, '0')), 4)::int, '0')"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders: survival time, event and covariates."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")
    )
    customer = table(spark, sf_dir, "customer")
    stage = F.lit(None).cast("string")
    for segment, name in reversed(STAGE_OF_SEGMENT.items()):
        stage = F.when(F.col("c_mktsegment") == segment, name).otherwise(stage)
    return customer.join(orders, customer.c_custkey == orders.case_id).select(
        F.col("case_id").alias("sample_id"),
        "case_id",
        F.datediff("last", "first").cast("bigint").alias("time"),
        (F.col("last") < F.lit("2001-01-01").cast("timestamp")).alias("event"),
        F.col("c_acctbal").alias("age_at_index"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None))
        .when(F.col("c_custkey") % 2 == 1, "male").otherwise("female").alias("gender"),
        stage.alias("ajcc_pathologic_stage"),
        F.lit("Tumor").alias("tissue_type"),
        F.col("c_nationkey").alias("site"),
    )


COHORT_SQL = """coh as (
  select c_custkey as sample_id, c_custkey as case_id,
         date_diff('day', min(o_orderdate), max(o_orderdate)) as time,
         max(o_orderdate) < timestamp '2001-01-01' as event,
         c_acctbal as age_at_index,
         case when c_custkey % 10 = 0 then null when c_custkey % 2 = 1 then 'male'
              else 'female' end as gender,
         case c_mktsegment when 'AUTOMOBILE' then 'Stage IA' when 'BUILDING' then 'Stage IIB'
              when 'FURNITURE' then 'Stage IIIA' when 'HOUSEHOLD' then 'Stage IVA'
              when 'MACHINERY' then 'Stage X' end as ajcc_pathologic_stage,
         case c_mktsegment when 'AUTOMOBILE' then 'I' when 'BUILDING' then 'II'
              when 'FURNITURE' then 'III' when 'HOUSEHOLD' then 'IV'
              else 'Unknown' end as stage_group,
         c_nationkey as site
  from customer join orders on o_custkey = c_custkey
  group by c_custkey, c_acctbal, c_mktsegment, c_nationkey)"""


def expression(spark: SparkSession, sf_dir: str, measure: str = "l_quantity",
               sample: str = "o_custkey") -> DataFrame:
    """Long matrix customer x brand with every cell present, zeros included.

    The brands are those of ``part``, a dictionary that each sample holds once.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", measure)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    present = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col(sample).alias("sample_id"), F.col("p_brand").alias("feature_id"))
        .agg(F.sum(measure).cast("double").alias("value"))
    )
    brands = part.agg(F.sort_array(F.collect_set("p_brand")).alias("b")).scalar()
    held = present.groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("cells"))
    return held.select("sample_id", "cells", F.explode(brands).alias("feature_id")).select(
        "sample_id", "feature_id",
        F.coalesce(F.try_element_at("cells", F.col("feature_id")), F.lit(0.0)).alias("value"))


EXPRESSION_SQL = """cell as (
  select o_custkey as sample_id, p_brand as feature_id, sum(l_quantity) as value
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  group by 1, 2),
brand as (select distinct p_brand as feature_id from part where p_brand is not null),
expr as (
  select s.sample_id, brand.feature_id, coalesce(cell.value, 0.0) as value
  from (select distinct sample_id from cell) s cross join brand
  left join cell on cell.sample_id = s.sample_id and cell.feature_id = brand.feature_id)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of ``expression``, read from their dictionary."""
    return table(spark, sf_dir, "part").where("p_brand is not null").select(
        F.col("p_brand").alias("feature_id")).distinct()


def sample_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the sample sheet: one sample per order, its customer is the case."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("case_id"),
        F.when(F.col("o_orderstatus") == "F", "Normal").otherwise("Tumor").alias("tissue_type"),
        (F.col("o_orderstatus") != "F").alias("is_tumor"),
    )


SHEET_SQL = """sheet as (
  select o_orderkey as sample_id, o_custkey as case_id,
         case when o_orderstatus = 'F' then 'Normal' else 'Tumor' end as tissue_type,
         o_orderstatus <> 'F' as is_tumor
  from orders)"""


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long matrix order x ship type (brand) for the dataset build."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        items.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("sample_id"), F.col("p_type").alias("feature_id"))
        .agg(F.sum("l_quantity").alias("value"))
    )


PROFILE_SQL = """profile as (
  select l_orderkey as sample_id, p_type as feature_id, sum(l_quantity) as value
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aliquot barcode per order, built from its site, customer and order keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    site = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    person = person_code(F.col("c_custkey"))
    code = F.lpad((F.col("o_orderkey") % 25).cast("string"), 2, "0")
    project = F.when(F.col("o_orderkey") % 7 == 0, "OTHR").otherwise("TCGA")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.concat_ws("-", project, site, person, F.concat(code, F.lit("A")),
                    F.lit("11R"), F.lit("A26X"), F.lit("07")).alias("barcode"),
    )


BARCODE_SQL = f"""bar as (
  select o_orderkey,
         case when o_orderkey % 7 = 0 then 'OTHR' else 'TCGA' end || '-' ||
         lpad(c_nationkey::varchar, 2, '0') || '-' || {person_code_sql("c_custkey")} || '-' ||
         lpad((o_orderkey % 25)::varchar, 2, '0') || 'A-11R-A26X-07' as barcode
  from orders join customer on o_custkey = c_custkey)"""


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense long matrix: vec_id x dimension."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), "label",
        F.posexplode("embedding").alias("feature_id", "value"),
    ).withColumn("value", F.col("value").cast("double"))


EMBEDDING_SQL = """emb as (
  select vec_id as sample_id, label, generate_subscripts(embedding, 1) - 1 as feature_id,
         unnest(embedding)::double as value
  from embeddings)"""

"""Parsing jobs on documents and files that are derived from the given tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.functions.numbers import rounded
from cohortmill.operators.filters import MIRNA
from cohortmill.plans import adapters as A
from cohortmill.plans.catalog import query
from cohortmill.session import checkpoint_dir
from cohortmill.sources import byte_files
from cohortmill.sources import files as SF
from cohortmill.sources import nested as N
from cohortmill.sources import quantification as QF
from cohortmill.sources import text_files
from cohortmill.streaming import ingest


def _folder(spark, name):
    """A new folder next to the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- quantification files -------------------------------------------------------------

def _quantification_folder(spark, sf_dir):
    """Tab-separated files, one per supplier: parts as genes, plus a summary row."""
    items = A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("p"))
    text = F.col("p").cast("string")
    count = F.col("q").cast("string")
    genes = items.select(
        F.col("l_suppkey").cast("string").alias("file"),
        F.concat(F.lit("ENSG"), F.col("l_partkey").cast("string")).alias("gene_id"),
        F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_name"),
        F.lit("protein_coding").alias("gene_type"), count.alias("unstranded"),
        F.when(F.col("q") > 30, "NA").otherwise(count).alias("stranded_first"),
        F.lit("-").alias("stranded_second"), text.alias("tpm_unstranded"),
        text.alias("fpkm_unstranded"), F.lit("0.5").alias("fpkm_uq_unstranded"))
    summary = A.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("file"), F.lit("N_unmapped").alias("gene_id"),
        *[F.lit("").alias(c) for c in fixed.RNA_COLUMNS[1:]])
    path = _folder(spark, "quantification")
    _write_text(genes.unionByName(summary), path, "tsv", "file")
    return path


def _write_text(rows, path, extension, *folders):
    """Tab-separated files named by the last of ``folders``, in folders named by the others; a file with
    many rows gets several parts. Folders stay few, so that a listing has no folder per file."""
    header = "\t".join(c for c in rows.columns if c not in folders)
    place = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
                               for c in folders])
    line = F.concat(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns if c not in folders]), F.lit("\n"))
    call = uuid.uuid4().hex

    def write(batches):
        task, written = TaskContext.get(), 0
        name = f"{call}-{task.partitionId():05d}.c000.{extension}"
        with text_files.Writer(path, name, header, task.taskAttemptId()) as files:
            for batch in batches:
                files.add(batch.column(0), batch.column(1))
                written += batch.num_rows
        yield pa.RecordBatch.from_pydict({"rows": [written]})

    lines = rows.hint("rebalance", *[F.col(c) for c in folders]).sortWithinPartitions(*folders)
    lines.select(place.alias("place"), line.alias("line")).mapInArrow(write, "rows long").agg(F.sum("rows")).first()


def _file_name():
    return F.regexp_extract(F.col("_metadata.file_path"), "/file=([^/.]*)[^/]*$", 1).alias("file")


@query("quantification_files", """with c as (select l_suppkey, l_partkey, sum(l_quantity)::bigint q,
  sum(l_extendedprice::decimal(18,2)) p from lineitem group by 1, 2)
select l_suppkey::varchar as file, count(*) as n_features, sum(q)::bigint as unstranded,
  sum(q) filter (q <= 30)::bigint as stranded_first, null::bigint as stranded_second,
  round(sum(p)::double, 2) as tpm_unstranded from c group by 1""")
def quantification_files(spark, sf_dir):
    path = _quantification_folder(spark, sf_dir)
    rows = QF.read_quantification(spark, path, glob=None, file=_file_name())
    return rows.groupBy("file").agg(
        F.count("*").alias("n_features"), F.sum("unstranded").alias("unstranded"),
        F.sum("stranded_first").alias("stranded_first"),
        F.sum("stranded_second").alias("stranded_second"),
        rounded(F.sum("tpm_unstranded"), 2).alias("tpm_unstranded"))


@query("mirna_files", """with c as (select l_suppkey, l_partkey, sum(l_quantity)::bigint q
  from lineitem group by 1, 2)
select l_suppkey::varchar as file, count(*) as n_features, count(distinct l_partkey) as n_ids,
  sum(q) filter (q <= 30)::bigint as read_count, round(sum(q) / 4.0::double, 2) as per_million,
  count(*) filter (q % 2 = 0) as n_cross_mapped from c group by 1""")
def mirna_files(spark, sf_dir):
    """miRNA files found by name in nested folders that also hold files of another kind."""
    items = A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q"))
    count = F.col("q").cast("string")
    rows = items.select(
        F.concat(F.lit("nation"), (F.col("l_suppkey") % 25).cast("string")).alias("folder"),
        F.col("l_suppkey").cast("string").alias("file"),
        F.concat(F.lit("hsa-mir-"), F.col("l_partkey").cast("string")).alias("miRNA_ID"),
        F.when(F.col("q") > 30, "NA").otherwise(count).alias("read_count"),
        (F.col("q") / 4).cast("decimal(12,2)").cast("string").alias("reads_per_million_miRNA_mapped"),
        F.when(F.col("q") % 2 == 0, "Y").otherwise("N").alias("cross-mapped"))
    path = _folder(spark, "mirna")
    _write_text(rows, path, "txt", "folder", "file")
    _write_text(rows.select("folder", "file", F.lit("not a quantification").alias("note")), path, "log",
                "folder", "file")
    # the files end as Spark's own do; that stands in for the portal's ending
    named = replace(MIRNA, file_suffixes=(".c000.txt",))
    return QF.read_quantification(spark, path, named, file=_file_name()).groupBy("file").agg(
        F.count("*").alias("n_features"), F.count_distinct("miRNA_ID").alias("n_ids"),
        F.sum("read_count").alias("read_count"),
        rounded(F.sum("reads_per_million_miRNA_mapped"), 2).alias("per_million"),
        F.count_if(F.col("`cross-mapped`") == "Y").alias("n_cross_mapped"))


@query("quantification_problems", """with c as (select l_suppkey::varchar as file,
  case when l_quantity = 50 then 'LRG' else 'ENSG' end || l_partkey as id from lineitem),
p as (select file, id, count(*) n from c group by 1, 2)
select file, count(*) filter (not starts_with(id, 'ENSG')) as n_foreign,
  count(*) filter (n > 1) as n_repeated, min(id) as example
from p where not starts_with(id, 'ENSG') or n > 1 group by 1""")
def quantification_problems(spark, sf_dir):
    prefix = F.when(F.col("l_quantity") == 50, "LRG").otherwise("ENSG")
    rows = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("file"),
        F.concat(prefix, F.col("l_partkey").cast("string")).alias("gene_id"))
    return QF.quantification_problems(rows)


@query("checked_ingest", """with c as (select l_suppkey k, l_partkey p, sum(l_quantity)::bigint q from lineitem group by 1, 2),
r as (select k, q, case when k % 10 = 3 and p % 2 = 0 then 'LRG' else 'ENSG' end || p as id, (k % 10 = 7 and p % 4 = 0)::int as bad,
    case when k % 10 = 5 and p % 3 = 0 then 2 else 1 end as n from c),
f as (select k, sum(n)::bigint as n_rows, count(*) filter (starts_with(id, 'LRG')) as n_foreign,
    count(*) filter (n > 1) as n_repeated, sum(bad)::bigint as n_malformed,
    min(id) filter (starts_with(id, 'LRG') or n > 1 or bad > 0) as example, sum(q)::bigint as q from r group by 1)
select k::varchar as file, k % 2 as wave, if(example is null, 'accepted', 'quarantined') as status, n_rows, n_foreign,
  n_repeated, n_malformed, example, if(example is null, q, null) as unstranded from f""")
def checked_ingest(spark, sf_dir):
    """A file per supplier, some with foreign or repeated ids or broken numbers, taken in two waves;
    a third run finds nothing new, and the last batch is committed once more."""
    items = A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    kind, part = F.col("l_suppkey") % 10, F.col("l_partkey")
    count = F.col("q").cast("string")
    genes = items.select(
        (F.col("l_suppkey") % 2).alias("wave"), F.col("l_suppkey").cast("string").alias("file"),
        F.concat(F.when((kind == 3) & (part % 2 == 0), "LRG").otherwise("ENSG"), part.cast("string")).alias("gene_id"),
        F.lit("g").alias("gene_name"), F.lit("protein_coding").alias("gene_type"),
        F.when((kind == 7) & (part % 4 == 0), "many").otherwise(count).alias("unstranded"),
        *[count.alias(c) for c in fixed.RNA_COLUMNS[4:]],
        F.explode(F.when((kind == 5) & (part % 3 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    ).drop("copy")
    path, out, progress = _folder(spark, "arriving"), _folder(spark, "ingested"), _folder(spark, "progress")

    def commit(text, batch, out, modality):
        ingest.commit_batch(text, batch, out, modality)
        ingest.commit_batch(text, batch, out, modality)

    for wave, one in ((0, ingest.commit_batch), (1, commit), (None, commit)):
        if wave is not None:
            _write_text(genes.where(F.col("wave") == wave).drop("wave"), path, "tsv", "file")
        ingest.ingest_new_files(spark, path, out, progress, glob=None, file=_file_name(), commit=one)
    kept = ingest.accepted_rows(spark, out).groupBy("file").agg(F.sum("unstranded").alias("unstranded"))
    return ingest.ledger(spark, out).withColumnRenamed("batch", "wave").join(kept, "file", "left").select(
        "file", "wave", "status", "n_rows", "n_foreign", "n_repeated", "n_malformed", "example", "unstranded")


@query("line_balance", """with l as (select doc_id as file,
  unnest(string_split(case when lang = 'en' then '# gene-model' || chr(10) else '' end || text
  || chr(10) || 'N_unmapped' || chr(9) || n_chars, chr(10))) as value from documents),
c as (select file, count(*) n_lines, count(*) filter (starts_with(value, '#')) n_comments,
  count(*) filter (starts_with(value, 'N_unmapped' || chr(9))) n_summary from l group by 1),
h as (select *, (n_lines > n_comments)::int::bigint as n_header from c)
select file, n_lines, n_comments, n_summary, n_header,
  n_lines - n_comments - n_header - n_summary as n_expected from h""")
def line_balance(spark, sf_dir):
    text = F.concat(F.when(F.col("lang") == "en", "# gene-model\n").otherwise(""), F.col("text"),
                    F.lit("\nN_unmapped\t"), F.col("n_chars").cast("string"))
    lines = A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file"), F.explode(F.split(text, "\n")).alias("value"))
    return QF.line_balance(lines)


@query("feature_dimension", """with g as (select 'ENSG' || p_brand as gene_id, p_name as gene_name,
  p_type as gene_type, min(p_partkey) as file from part group by 1, 2, 3)
select gene_id, arg_min(gene_name, file) as gene_name, arg_min(gene_type, file) as gene_type,
  count(distinct gene_type) as n_types from g group by 1""")
def feature_dimension(spark, sf_dir):
    rows = A.table(spark, sf_dir, "part").select(
        F.concat(F.lit("ENSG"), F.col("p_brand")).alias("gene_id"),
        F.col("p_name").alias("gene_name"), F.col("p_type").alias("gene_type"),
        F.col("p_partkey").alias("file"))
    return QF.feature_dimension(rows)


@query("metric_from_parquet", """select l_suppkey::varchar as file, l_partkey as feature_id,
  sum(l_quantity) as value from lineitem group by 1, 2""")
def metric_from_parquet(spark, sf_dir):
    path = _folder(spark, "parsed")
    rows = A.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("file"), F.col("l_partkey").alias("gene_id")).agg(
        F.sum("l_quantity").alias("unstranded"), F.sum("l_extendedprice").alias("tpm_unstranded"))
    QF.write_long(rows, path)
    return QF.read_metric(spark, path, "gene_id", "unstranded")


# ---- nested documents -----------------------------------------------------------------

_CASES_SQL = """with o as (select 'C' || o_orderkey as id, o_orderstatus as s,
  o_custkey, o_orderpriority as p from orders),
d as (select id, s, o_custkey, p, 'true' as flag, o_custkey || '.5' as lf, 'Stage I' as st from o
    where s = 'F'
  union all select id, s, o_custkey, p, 'false', '', '' from o where s = 'F'
  union all select id, s, o_custkey, p, '', '', '' from o where s <> 'F')
select id as "cases.submitter_id", 'Lung' as "cases.primary_site",
  case s when 'F' then 'Dead' when 'O' then 'Alive' else '' end as "demographic.vital_status",
  case when s = 'F' then o_custkey::varchar else '' end as "demographic.days_to_death",
  (o_custkey % 90)::varchar as "demographic.age_at_index", '' as "demographic.gender",
  p as "demographic.race", flag as "diagnoses.diagnosis_is_primary_disease",
  lf as "diagnoses.days_to_last_follow_up", st as "diagnoses.ajcc_pathologic_stage" from d"""


@query("flatten_cases", _CASES_SQL)
def flatten_cases(spark, sf_dir):
    return N.flatten_cases(N.parse_documents(_case_documents(spark, sf_dir), "text", N.CASE_SCHEMA))


def _case_documents(spark, sf_dir):
    """A case per order as JSON text, with the order's key."""
    dead = F.col("o_orderstatus") == "F"
    diagnosis = "diagnosis_is_primary_disease"
    document = F.to_json(F.struct(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("submitter_id"),
        F.lit("Lung").alias("primary_site"),
        F.struct(
            F.when(dead, "Dead").when(F.col("o_orderstatus") == "O", "Alive").alias("vital_status"),
            F.when(dead, F.col("o_custkey")).alias("days_to_death"),
            (F.col("o_custkey") % 90).alias("age_at_index"),
            F.col("o_orderpriority").alias("race")).alias("demographic"),
        F.when(dead, F.array(
            F.struct(F.lit(True).alias(diagnosis),
                     (F.col("o_custkey") + 0.5).cast("decimal(12,1)").alias("days_to_last_follow_up"),
                     F.lit("Stage I").alias("ajcc_pathologic_stage")),
            F.struct(F.lit(False).alias(diagnosis),
                     F.lit(None).cast("decimal(12,1)").alias("days_to_last_follow_up"),
                     F.lit(None).cast("string").alias("ajcc_pathologic_stage")))
        ).when(F.col("o_orderstatus") == "P", F.expr(
            "cast(array() as array<struct<diagnosis_is_primary_disease: boolean, "
            "days_to_last_follow_up: decimal(12,1), ajcc_pathologic_stage: string>>)"))
        .alias("diagnoses")))
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), document.alias("text"))


def _array_files(texts, path, opening, closing, files=5, file_rows=200_000):
    """JSON arrays of the texts with ``opening`` and ``closing`` around them: at least ``files`` files, and
    as many more as keep a file at about ``file_rows`` texts, each written by a task of its own."""
    files = max(files, -(-texts.count() // file_rows))
    texts = texts.select(F.pmod(F.xxhash64("key"), F.lit(files)).alias("file"), "key", "text")
    first = texts.groupBy("file").agg(F.min("key").alias("first"))
    lines = texts.join(F.broadcast(first), "file").select(  # a row per file
        "file", F.lit(1).alias("part"), "key", F.concat(F.when(F.col("key") == F.col("first"), "").otherwise(","), "text").alias("line"))
    around = first.select("file", F.explode(F.array(*[
        F.struct(F.lit(part).alias("part"), F.col("first").alias("key"), F.lit(text).alias("line"))
        for part, text in ((0, opening), (2, closing))])).alias("of")).select("file", "of.*")
    lines.unionByName(around).repartitionById(files, F.col("file").cast("int")).sortWithinPartitions("file", "part", "key").select(
        "file", "line").write.partitionBy("file").text(path)


def _framed_array_files(texts, path, opening, closing, files=5, file_rows=200_000):
    """As ``_array_files``, but in zstd frames and written by the tasks that make the texts: neither plain
    files nor a shuffle of texts lie on disk. Within a file the texts are in the order of their task."""
    rows = min(file_rows, max(1, -(-texts.count() // files)))

    def write(batches):
        task, written = TaskContext.get(), 0
        with text_files.ArrayWriter(path, f"{task.partitionId():05d}", opening, closing, rows, task.taskAttemptId()) as arrays:
            for batch in batches:
                arrays.add(batch.column(0))
                written += batch.num_rows
        yield pa.RecordBatch.from_pydict({"rows": [written]})

    lines = texts.select(F.concat(F.lit(text_files.ArrayWriter.BETWEEN), "text").alias("line"))
    lines.mapInArrow(write, "rows long").agg(F.sum("rows")).first()


@query("cases_of_array_files", _CASES_SQL)
def cases_of_array_files(spark, sf_dir):
    """The same cases out of files that are one JSON array each, cut into ranges of a tenth megabyte."""
    path = _folder(spark, "cases")
    _array_files(_case_documents(spark, sf_dir), path, "[", "]")
    return N.flatten_cases(N.read_documents(spark, path, N.CASE_SCHEMA, range_bytes=100_000))


def _hits(spark, sf_dir):
    return N.parse_documents(_hit_documents(spark, sf_dir), "text", N.FILE_SCHEMA)


def _hit_documents(spark, sf_dir):
    """A file hit per order line as JSON text; some levels are empty."""
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                      F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    aliquots = F.when(F.col("l_quantity") == 1, F.array()).otherwise(F.array(F.struct(
        F.concat(F.lit("u"), key).alias("aliquot_id"), F.concat(F.lit("A"), key).alias("submitter_id"))))
    sample = F.struct(
        F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("submitter_id"),
        F.array(F.struct(F.array(F.struct(aliquots.alias("aliquots"))).alias("analytes")))
        .alias("portions"))
    cases = F.when(F.col("l_quantity") == 2, F.lit(None)).otherwise(F.array(F.struct(
        F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("case_id"),
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("submitter_id"),
        F.array(sample).alias("samples"))))
    document = F.to_json(F.struct(
        key.alias("file_id"), F.concat(key, F.lit(".tsv")).alias("file_name"),
        F.md5(key.cast("binary")).alias("md5sum"),
        F.when(F.col("l_quantity") != 3, F.col("l_partkey")).alias("file_size"),
        F.lit("RNA-Seq").alias("experimental_strategy"), cases.alias("cases"),
        F.struct(F.col("l_returnflag").alias("workflow_type")).alias("analysis")))
    return A.table(spark, sf_dir, "lineitem").select(key.alias("key"), document.alias("text"))


_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


_HITS_SQL = f"""select {_KEY} as file_id, {_KEY} || '.tsv' as file_name,
  md5({_KEY}) as md5sum, l_partkey as file_size, '' as data_type,
  'RNA-Seq' as experimental_strategy, 'S' || l_orderkey as sample_id,
  'C' || l_suppkey as case_submitter_id, 'A' || {_KEY} as aliquot_barcode,
  'c' || l_suppkey as case_uuid, 'u' || {_KEY} as aliquot_uuid, l_returnflag as workflow_type,
  '' as workflow_version from lineitem where l_quantity > 3"""


@query("flatten_file_hits", _HITS_SQL)
def flatten_file_hits(spark, sf_dir):
    return N.flatten_hits(_hits(spark, sf_dir))


@query("hits_of_response_pages", _HITS_SQL)
def hits_of_response_pages(spark, sf_dir):
    """The same hits out of response pages, the hits between other fields of the page."""
    path = _folder(spark, "pages")
    opening = '{"warnings": {"hits": [1]}, "data": {"pagination": {"count": 10, "sort": ["\\"]"]}, "hits": ['
    _framed_array_files(_hit_documents(spark, sf_dir), path, opening, '], "other": [{"file_id": "x"}]}}')
    return N.flatten_hits(N.read_hits(spark, path, N.FILE_SCHEMA, range_bytes=1_000_000))


@query("file_hit_problems", """select case l_quantity when 1 then 'empty aliquots'
  when 2 then 'empty cases' else 'missing field' end as problem, count(*) as n
from lineitem where l_quantity <= 3 group by 1""")
def file_hit_problems(spark, sf_dir):
    rows = _hits(spark, sf_dir).select(N.hit_problem().alias("problem"))
    return rows.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


def _records(spark, sf_dir):
    """A metadata record per order with its aliquot barcode and reads."""
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                     "o_orderstatus")
    key = F.col("o_orderkey").cast("string")
    entity = F.struct(
        F.col("barcode").alias("entity_submitter_id"), F.lit("aliquot").alias("entity_type"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("case_id"),
        F.concat(F.lit("e"), key).alias("entity_id"))
    reads = F.struct(
        (F.col("o_orderkey") * 1000).alias("total_reads"), F.lit(0.5).alias("proportion_reads_mapped"),
        F.lit(36.0).alias("average_base_quality"), F.lit(48.0).alias("average_read_length"))
    document = F.to_json(F.struct(
        key.alias("file_id"), F.concat(key, F.lit(".tsv")).alias("file_name"),
        F.lit("d41d8cd9").alias("md5sum"), F.col("o_orderkey").alias("file_size"),
        F.lit("Gene Expression Quantification").alias("data_type"),
        F.lit("RNA-Seq").alias("experimental_strategy"),
        F.array(entity).alias("associated_entities"),
        F.struct(F.lit("STAR - Counts").alias("workflow_type"), F.lit("v1").alias("workflow_version"),
                 F.when(F.col("o_orderstatus") == "P", F.array()).otherwise(F.array(reads))
                 .alias("input_files")).alias("analysis")))
    texts = A.barcodes(spark, sf_dir).join(orders, "o_orderkey").select(document.alias("text"))
    return N.parse_documents(texts, "text", N.METADATA_SCHEMA)


_RECORDS = f"""{A.BARCODE_SQL}, rec as (select o_orderkey, o_custkey, barcode, o_orderstatus,
  case when not regexp_matches(barcode,
    '^TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}}-[0-9]{{2}}[A-Z]-[0-9]{{2}}[A-Z]-[A-Z0-9]{{4}}-[0-9]{{2}}$')
  then 'bad aliquot barcode' when o_orderstatus = 'P' then 'no input file' end as problem
  from bar join orders using (o_orderkey))"""


@query("flatten_metadata", f"""with {_RECORDS}
select o_orderkey::varchar as file_id, o_orderkey || '.tsv' as file_name, 'd41d8cd9' as md5sum,
  o_orderkey as file_size, 'Gene Expression Quantification' as data_type,
  'RNA-Seq' as experimental_strategy,
  array_to_string(string_split(barcode, '-')[1:4], '-') as sample_id,
  array_to_string(string_split(barcode, '-')[1:3], '-') as case_submitter_id,
  barcode as aliquot_barcode, 'c' || o_custkey as case_uuid, 'e' || o_orderkey as aliquot_uuid,
  'STAR - Counts' as workflow_type, 'v1' as workflow_version, o_orderkey * 1000 as total_reads,
  0.5::double as proportion_reads_mapped, 36.0::double as average_base_quality,
  48.0::double as average_read_length from rec where problem is null""")
def flatten_metadata(spark, sf_dir):
    return N.flatten_metadata(_records(spark, sf_dir))


@query("metadata_problems", f"""with {_RECORDS}
select problem, count(*) as n from rec where problem is not null group by 1""")
def metadata_problems(spark, sf_dir):
    rows = _records(spark, sf_dir).select(N.metadata_problem().alias("problem"))
    return rows.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


# ---- whole files ----------------------------------------------------------------------

@query("file_integrity", """with m as (select l.doc_id, case when quality = 1 then md5(text)
    when toxic = 1 then null else md5('other') end as want, n_chars as size
  from labels l left join documents d on d.doc_id = l.doc_id)
select m.doc_id, case when d.text is null then false else coalesce(md5(text) = want, want is null)
  end as verified, case when d.text is null then 'missing'
  when coalesce(md5(text) = want, want is null) then 'present' else 'damaged' end as status,
  strlen(text) = m.size as size_matches
from m left join (select * from documents where lang <> 'de') d on d.doc_id = m.doc_id""")
def file_integrity(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    files = docs.where("lang <> 'de'").select(
        "doc_id", F.encode("text", "UTF-8").alias("content"),
        F.octet_length("text").cast("bigint").alias("size"))
    want = (F.when(F.col("quality") == 1, F.md5(F.encode("text", "UTF-8")))
            .when(F.col("toxic") == 1, F.lit(None)).otherwise(F.md5(F.lit("other").cast("binary"))))
    metadata = A.table(spark, sf_dir, "labels").join(docs, "doc_id", "left").select(
        "doc_id", want.alias("md5sum"), F.col("n_chars").alias("file_size"))
    return SF.integrity(files, metadata, "doc_id").select(
        "doc_id", "verified", "status", "size_matches")


@query("file_digests", """with l as (select l_suppkey as k, string_agg(l_orderkey || '|' || l_linenumber || '|' || l_partkey,
    chr(10) order by l_orderkey, l_linenumber, l_partkey) || chr(10) as body from lineitem group by 1),
m as (select k, case when k % 11 = 0 then null when k % 7 = 0 then md5('other') else md5(body) end as want,
    strlen(body) + (k % 3 = 0)::int as want_size, case when k % 5 <> 0 then md5(body) end as digest,
    case when k % 5 <> 0 then strlen(body) end as size from l)
select k::varchar as file, digest, size, digest is not null and coalesce(digest = want, want is null) as verified,
  case when digest is null then 'missing' when coalesce(digest = want, want is null) then 'present'
  else 'damaged' end as status, size = want_size as size_matches from m""")
def file_digests(spark, sf_dir):
    """A file of lines per supplier, streamed through its digest; some are missing or unlike expected."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey")
    lines = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("file"), *keys, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("line"))
    path = _folder(spark, "files")
    written = lines.where(F.col("file").cast("bigint") % 5 != 0)
    written.repartition("file").sortWithinPartitions("file", *keys).select("file", "line").write.partitionBy("file").text(path)
    found = byte_files.read_digests(spark, path).withColumn("file", F.regexp_extract("path", "/file=([^/]*)/", 1))
    body = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*keys, "line"))), lambda r: r["line"]), "\n"),
                    F.lit("\n")).cast("binary")
    key = F.col("file").cast("bigint")
    expected = lines.groupBy("file").agg(body.alias("body")).select(
        "file", F.when(key % 11 == 0, None).when(key % 7 == 0, F.md5(F.lit("other").cast("binary"))).otherwise(F.md5("body")).alias("md5sum"),
        (F.octet_length("body") + (key % 3 == 0).cast("int")).cast("bigint").alias("file_size"))
    return SF.integrity(found, expected, "file").select(
        "file", F.col("actual_md5").alias("digest"), F.col("actual_size").alias("size"), "verified", "status", "size_matches")


@query("file_kinds", """select doc_id, case lang when 'en' then 'star' when 'fr' then 'clinical'
  when 'de' then 'sample_sheet' when 'es' then 'star' else 'unknown' end as kind
from documents""")
def file_kinds(spark, sf_dir):
    """Documents under a header that depends on their language."""
    header = (F.when(F.col("lang") == "en", "# gene-model: v36\n")
              .when(F.col("lang") == "fr", "cases.submitter_id\tx\n")
              .when(F.col("lang") == "de", "File ID\tFile Name\tSample ID\n")
              .when(F.col("lang") == "es", "gene_id\ttpm_unstranded\n").otherwise("doc\ttext\n"))
    files = A.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(header, F.col("text")).alias("text"))
    return SF.upload_check(files, "star").select("doc_id", "kind")

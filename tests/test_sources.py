import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortmill.functions import fixed
from cohortmill.operators.filters import MIRNA, RNASEQ
from cohortmill.plans.source_queries import _file_name, _write_text
from cohortmill.sources import files as SF
from cohortmill.sources import nested as N
from cohortmill.sources import quantification as QF
from cohortmill.sources import sinks, tables, text_files
from tests.conftest import CLINICAL_HEADER, N_CASES, rows_as

HEADER = "\t".join(fixed.RNA_COLUMNS)


def star_text(values, ids=("ENSG01.1", "ENSG02.7", "ENSG03.2"), comment=True):
    lines = ["# gene-model: GENCODE v36"] if comment else []
    lines.append(HEADER)
    lines += [f"{m}\t\t\t10\t20\t30\t\t\t" for m in fixed.RNA_SUMMARY_ROWS]
    for i, v in zip(ids, values):
        lines.append(f"{i}\tN{i[-3]}\tprotein_coding\t{v}\t{v}\tNA\t{v}.5\t-\t1.25")
    return "\n".join(lines) + "\n"


@pytest.fixture
def star_dir(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "u1.rna_seq.augmented_star_gene_counts.tsv").write_text(star_text([1, 2, 3]))
    (tmp_path / "u2_rna_seq_augmented_star_gene_counts.tsv").write_text(star_text([4, 5, 6]))
    (tmp_path / "notes.tsv").write_text("nothing\tuseful\n1\t2\n")
    return tmp_path


def test_quantification_files_are_found_and_typed(spark, star_dir):
    rows = QF.checked(QF.read_quantification(spark, str(star_dir)))
    assert dict(rows.dtypes)["unstranded"] == "bigint" and dict(rows.dtypes)["tpm_unstranded"] == "double"
    got = rows_as(rows, "file", "gene_id", "unstranded", "stranded_second", "tpm_unstranded", "fpkm_unstranded")
    assert got[0] == ("u1", "ENSG01.1", 1, None, 1.5, None) and len(got) == 6
    assert {g[0] for g in got} == {"u1", "u2"}


def test_line_balance_of_files(spark, star_dir):
    rows = QF.read_quantification(spark, str(star_dir))
    check = QF.balance_check(QF.line_balance(QF.read_lines(spark, str(star_dir))), rows)
    assert [tuple(r) for r in check.orderBy("file").select(
        "file", "n_lines", "n_comments", "n_summary", "n_expected", "balanced").collect()] == [
        ("u1", 9, 1, 4, 3, True), ("u2", 9, 1, 4, 3, True)]


@pytest.mark.parametrize("ids", [("ENSG1", "ENSG1", "ENSG2"), ("ENSG1", "LRG1", "ENSG2")])
def test_bad_feature_ids(spark, tmp_path, ids):
    (tmp_path / "u.rna_seq.augmented_star_gene_counts.tsv").write_text(star_text([1, 2, 3], ids))
    with pytest.raises(ValueError, match="bad feature ids"):
        QF.checked(QF.read_quantification(spark, str(tmp_path)))


def test_missing_column(spark, tmp_path):
    (tmp_path / "u.rna_seq.augmented_star_gene_counts.tsv").write_text("gene_id\tgene_name\nENSG1\ta\n")
    with pytest.raises(ValueError, match="lack columns"):
        QF.read_quantification(spark, str(tmp_path))


def test_file_with_other_column_order_is_an_error(spark, star_dir):
    turned = "\t".join(reversed(fixed.RNA_COLUMNS))
    (star_dir / "u3.rna_seq.augmented_star_gene_counts.tsv").write_text(turned + "\n" + "\t".join("123456789") + "\n")
    with pytest.raises(Exception, match="(?i)header|conform"):
        QF.read_quantification(spark, str(star_dir)).collect()


def test_folders_are_listed_twice_at_most(spark, tmp_path):
    for i in range(40):  # more than Spark lists on the driver
        folder = tmp_path / f"a [{i}] {{x}} 100%25"
        folder.mkdir()
        (folder / f"u{i}.rna_seq.augmented_star_gene_counts.tsv").write_text(star_text([i, 2, 3]))
    context = spark.sparkContext
    context.setJobGroup("listing", "")
    try:
        rows = QF.read_quantification(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    assert stages.count(40) <= 2
    assert rows.count() == 120 and rows.where("gene_id = 'ENSG01.1'").agg(F.sum("unstranded")).first()[0] == sum(range(40))


def test_built_files_have_no_folder_each(spark, tmp_path):
    rows = spark.range(600).selectExpr("id % 3 as folder", "if(id % 60 = 7, null, id % 60) as file", "string(id) as a", "if(id < 300, null, 'x') as `b-c`")
    _write_text(rows, str(tmp_path / "x"), "txt", "folder", "file")
    assert sorted(p.name for p in (tmp_path / "x").rglob("*") if p.is_dir()) == ["folder=0", "folder=1", "folder=2"]
    files = list((tmp_path / "x").glob("*/*"))
    assert len(files) == 60 and all(f.read_text().startswith("a\tb-c\n") and f.name.endswith(".c000.txt") for f in files)
    back = spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path / "x"))
    got = back.select(_file_name(), "a", "`b-c`").selectExpr("file", "int(a) as a", "`b-c` as b").orderBy("a").collect()
    assert [tuple(r) for r in got] == [
        ("__HIVE_DEFAULT_PARTITION__" if i % 60 == 7 else str(i % 60), i, None if i < 300 else "x") for i in range(600)]


def test_a_task_that_runs_again_leaves_a_file_once(tmp_path):
    for attempt in (1, 2):
        with text_files.Writer(str(tmp_path), "0.txt", "h", attempt) as files:
            files.add(pa.array(["f/a", "f/a", "f/b"]), pa.array(["0\n", "1\n", "2\n", "3\n"])[1:])
            files.add(pa.array(["f/b"]), pa.array(["4\n"]))
    assert {f.name: f.read_text() for f in tmp_path.glob("f/*")} == {"a.0.txt": "h\n1\n2\n", "b.0.txt": "h\n3\n4\n"}
    assert not list(tmp_path.glob("f/.*"))


def test_mirna_files(spark, tmp_path):
    text = "\t".join(fixed.MIRNA_COLUMNS) + "\nhsa-let-7a-1\t100\t12.5\tN\nhsa-mir-1-1\t0\t0.0\tN\nhsa-mir-155\t7\t1.0\tY\n"
    (tmp_path / "m1.mirbase21.mirnas.quantification.txt").write_text(text)
    (tmp_path / "m2.mirnas.quantification.txt").write_text(text)
    rows = QF.checked(QF.read_quantification(spark, str(tmp_path), MIRNA), MIRNA)
    assert dict(rows.dtypes)["read_count"] == "bigint"
    assert rows_as(rows.where("file = 'm1'"), "miRNA_ID", "read_count", "`cross-mapped`") == [
        ("hsa-let-7a-1", 100, "N"), ("hsa-mir-1-1", 0, "N"), ("hsa-mir-155", 7, "Y")]
    (tmp_path / "m3.mirnas.quantification.txt").write_text(text.replace("hsa-mir-155", "mmu-mir-1"))
    with pytest.raises(ValueError):
        QF.checked(QF.read_quantification(spark, str(tmp_path), MIRNA), MIRNA)


def test_write_and_read_metric(spark, star_dir, tmp_path):
    out = str(tmp_path / "out")
    QF.write_long(QF.read_quantification(spark, str(star_dir)), out, by="file")
    back = QF.read_metric(spark, out, "gene_id", "unstranded")
    assert back.agg(F.sum("value")).first()[0] == 21
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<gene_id:string,unstranded:bigint>" in plan


def test_feature_dimension_reports_conflicts(spark):
    rows = spark.createDataFrame([("f1", "ENSG1", "A", "x"), ("f2", "ENSG1", "A", "y"), ("f1", "ENSG2", "B", "x")],
                                 "file string, gene_id string, gene_name string, gene_type string")
    assert rows_as(QF.feature_dimension(rows)) == [("ENSG1", "A", "x", 2), ("ENSG2", "B", "x", 1)]


# ---- clinical and sheet ---------------------------------------------------------------

def test_clinical_rows(spark, clinical):
    rows = clinical.collect()
    assert len(rows) == N_CASES and clinical.columns == list(tables.CLINICAL_COLUMNS)
    assert all(r["event"] == (r["vital_status"] == "Dead") for r in rows)
    assert all(r["time"] == (r["days_to_death"] if r["event"] else r["days_to_last_follow_up"]) for r in rows)
    assert all(r["race"] is None for r in rows)


def raw_clinical(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in CLINICAL_HEADER))


def test_clinical_edge_cases(spark):
    def row(case, vital, death, follow, stage="Stage I", flag="true"):
        return [case, "Lung", vital, death, "60.5", "male", "x", flag, follow, stage]

    got = {r["case_submitter_id"]: r for r in tables.clinical_rows(raw_clinical(
        spark,
        row("A", "Dead", "67.9", "'--"), row("B", "'--", "5", "9"), row("C", "Alive", "5", "'--"),
        row("D", "Alive", "", "3", "Stage II"), row("D", "Alive", "", "3", "Stage I"),
        row("E", "Dead", "1", "", flag="false"))).collect()}
    assert set(got) == {"A", "B", "D"}
    assert got["A"]["time"] == 67 and got["A"]["age_at_index"] is None
    assert got["B"]["event"] is None and got["B"]["time"] == 9
    assert got["D"]["ajcc_pathologic_stage"] == "Stage I"


def test_clinical_errors(spark, tmp_path):
    line = ["TCGA-44-0001", "Lung", "Gone", "5", "60", "male", "x", "true", "7", "Stage I"]
    path = tmp_path / "c.tsv"
    path.write_text("\t".join(CLINICAL_HEADER) + "\n" + "\t".join(line) + "\n")
    with pytest.raises(ValueError, match="vital_status"):
        tables.read_clinical(spark, str(path))
    path.write_text("\t".join(CLINICAL_HEADER[1:]) + "\n" + "\t".join(line[1:]) + "\n")
    with pytest.raises(ValueError, match="lacks columns"):
        tables.read_clinical(spark, str(path))


UUID = "01234567-89ab-cdef-0123-456789abcde"


def write_sheet(path, rows):
    names = list(tables.SHEET_NAMES)
    path.write_text("\t".join(names) + "\n" + "".join("\t".join(r) + "\n" for r in rows))
    return str(path)


def test_sample_sheet(spark, tmp_path):
    path = write_sheet(tmp_path / "s.tsv", [
        [UUID + "0", "a.tsv", "TCGA-44-0001", "TCGA-44-0001-01A", "Tumor"],
        [UUID + "1", "b.tsv", "TCGA-44-0001", "TCGA-44-0001-11A", "Normal"]])
    sheet = tables.read_sample_sheet(spark, path)
    assert rows_as(sheet, "file_name", "tcga_sample_code", "is_tumor") == [("a.tsv", "01A", True), ("b.tsv", "11A", False)]
    assert [r[0] for r in sheet.orderBy("position").select("file_name").collect()] == ["a.tsv", "b.tsv"]


@pytest.mark.parametrize("change, message", [
    ((0, "not-a-uuid"), "file_id"), ((2, "X-1"), "case_id"), ((3, "TCGA-44-0001"), "sample_id"),
    ((4, "Blood"), "tissue_type")])
def test_sample_sheet_errors(spark, tmp_path, change, message):
    row = [UUID + "0", "a.tsv", "TCGA-44-0001", "TCGA-44-0001-01A", "Tumor"]
    row[change[0]] = change[1]
    with pytest.raises(ValueError, match=message):
        tables.read_sample_sheet(spark, write_sheet(tmp_path / "s.tsv", [row]))


def test_repeated_file_id(spark, tmp_path):
    row = [UUID + "0", "a.tsv", "TCGA-44-0001", "TCGA-44-0001-01A", "Tumor"]
    with pytest.raises(ValueError, match="repeated file_id"):
        tables.read_sample_sheet(spark, write_sheet(tmp_path / "s.tsv", [row, row]))


# ---- nested documents -----------------------------------------------------------------

def test_case_pages(spark, tmp_path):
    hits = [
        {"submitter_id": "A", "primary_site": "Lung", "demographic": {"vital_status": "Dead", "days_to_death": 5},
         "diagnoses": [{"diagnosis_is_primary_disease": True, "ajcc_pathologic_stage": "Stage I"},
                       {"diagnosis_is_primary_disease": False}]},
        {"submitter_id": "B", "diagnoses": []}, {"submitter_id": "C"}, {"submitter_id": " "}, {"primary_site": "Lung"}]
    (tmp_path / "page.json").write_text(json.dumps({"data": {"hits": hits}}))
    read = N.read_hits(spark, str(tmp_path), N.CASE_SCHEMA)
    assert [r[0] for r in read.select(N.case_problem()).collect()].count("missing submitter_id") == 2
    rows = N.flatten_cases(read)
    assert rows.columns == CLINICAL_HEADER
    assert rows_as(rows, "`cases.submitter_id`", "`diagnoses.diagnosis_is_primary_disease`", "`demographic.days_to_death`") == [
        ("A", "false", "5"), ("A", "true", "5"), ("B", "", ""), ("C", "", "")]


def test_metadata_documents(spark, tmp_path):
    def record(i, barcode="TCGA-44-0001-01A-11R-A26X-07", inputs=1):
        read = {"total_reads": 10, "proportion_reads_mapped": 0.9, "average_base_quality": 36.0, "average_read_length": 48.0}
        return {"file_id": f"f{i}", "file_name": "n", "md5sum": "m", "file_size": 3, "data_type": "d",
                "experimental_strategy": "e",
                "associated_entities": [{"entity_submitter_id": barcode, "entity_type": "aliquot", "case_id": "c", "entity_id": "e"}],
                "analysis": {"workflow_type": "w", "workflow_version": "v", "input_files": [read] * inputs}}

    (tmp_path / "m.json").write_text(json.dumps([record(1), record(2, "bad"), record(3, inputs=0)]))
    records = N.read_documents(spark, str(tmp_path), N.METADATA_SCHEMA)
    flat = N.require_unique(N.flatten_metadata(records)).collect()
    assert len(flat) == 1 and len(flat[0]) == 17
    assert (flat[0]["sample_id"], flat[0]["case_submitter_id"]) == ("TCGA-44-0001-01A", "TCGA-44-0001")
    problems = [r[0] for r in records.orderBy("file_id").select(N.metadata_problem()).collect()]
    assert problems == [None, "bad aliquot barcode", "no input file"]


def test_file_hits(spark, tmp_path):
    sample = {"submitter_id": "S", "portions": [{"analytes": [{"aliquots": [{"aliquot_id": "u", "submitter_id": "A"}]}]}]}
    good = {"file_id": "1", "file_name": "n", "md5sum": "m", "file_size": 3, "cases": [{"case_id": "c", "submitter_id": "C", "samples": [sample]}]}
    empty = dict(good, file_id="2", cases=[])
    (tmp_path / "p.json").write_text(json.dumps({"data": {"hits": [good, empty]}}))
    hits = N.read_hits(spark, str(tmp_path), N.FILE_SCHEMA)
    flat = N.flatten_hits(hits)
    assert len(flat.columns) == 13
    assert rows_as(flat, "file_id", "sample_id", "aliquot_barcode", "workflow_type") == [("1", "S", "A", "")]
    assert [r[0] for r in hits.orderBy("file_id").select(N.hit_problem()).collect()] == [None, "empty cases"]
    with pytest.raises(ValueError, match="repeated"):
        N.require_unique(hits.unionAll(hits))


# ---- whole files and sinks --------------------------------------------------------------

def test_integrity(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"other")
    metadata = spark.createDataFrame(
        [("a.txt", hashlib.md5(b"hello").hexdigest(), 5), ("b.txt", "0" * 32, 9), ("c.txt", "x", 1)],
        "file_name string, md5sum string, file_size bigint")
    got = SF.integrity(SF.read_files(spark, str(tmp_path)), metadata)
    assert rows_as(got, "file_name", "verified", "status", "size_matches") == [
        ("a.txt", True, "present", True), ("b.txt", False, "damaged", False), ("c.txt", False, "missing", None)]


def test_file_kinds(spark):
    texts = {
        "star": ["# gene-model: x\ngene_id\n", "a\tb\nN_unmapped\t1\n", "gene_id\ttpm_unstranded\n", "# c\ngene_id\ttpm_unstranded\n"],
        "clinical": ["cases.submitter_id\tx\n", "x\tdiagnoses.ajcc_pathologic_stage\r\n1"],
        "sample_sheet": ["File ID\tFile Name\tCase ID\n"],
        "unknown": ["", "File ID\tFile Name\n", "x"],
    }
    rows = [(k, t) for k, group in texts.items() for t in group]
    df = SF.upload_check(spark.createDataFrame(rows, "want string, text string"), "clinical")
    assert all(r["want"] == r["kind"] for r in df.collect())
    assert df.where("fits").count() == 2


def test_sheet_and_report_sinks(spark, tmp_path):
    metadata = spark.createDataFrame(
        [("f1", "n1", "d", "e", "TCGA-44-0001", "TCGA-44-0001-11A")],
        "file_id string, file_name string, data_type string, experimental_strategy string, case_submitter_id string, sample_id string")
    sinks.write_text_table(tables.sheet_from_metadata(metadata, "P"), str(tmp_path / "sheet"))
    back = tables.read_text_table(spark, str(tmp_path / "sheet"))
    assert back.columns == ["File ID", "File Name", "Data Type", "Data Category", "Project ID", "Case ID",
                            "Sample ID", "Tissue Type", "Sample Type"]
    assert tuple(back.first())[-2:] == ("Normal", "Solid Tissue Normal")
    issues = spark.createDataFrame([("error", "x", "m", {"a": "b"})], "severity string, category string, message string, context map<string,string>")
    sinks.write_issue_report(issues, str(tmp_path / "qc"))
    assert spark.read.json(str(tmp_path / "qc")).first()["context"]["a"] == "b"


def test_modality_registry():
    from cohortmill.operators.filters import get_modality

    assert get_modality("rnaseq") is RNASEQ and MIRNA.portal_filters()["workflow_type"] == "BCGSC miRNA Profiling"
    with pytest.raises(KeyError):
        get_modality("protein")

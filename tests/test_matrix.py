import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import components as K
from cohortmill.operators import matrix as M
from cohortmill.operators.filters import MIRNA, RNASEQ, detect_modality, resolve_metric
from cohortmill.plans import builds
from tests.conftest import N_FEATURES, rows_as

SUFFIX = RNASEQ.file_suffixes[0]


@pytest.fixture(scope="module")
def quant(spark):
    cells = [(f"u{f}{SUFFIX}", f"ENSG{g}.1", t, v, v / 2) for f, values in enumerate(([10, 20, 30], [11, 21, 31], [12, 22, 32]))
             for g, (t, v) in enumerate(zip(("protein_coding", "protein_coding", "lncRNA"), values))]
    return spark.createDataFrame(cells, "file_name string, gene_id string, gene_type string, unstranded bigint, tpm_unstranded double")


def sheet_of(spark, *samples):
    return spark.createDataFrame([(f"u{i}{SUFFIX}", s, i) for i, s in enumerate(samples)],
                                 "file_name string, sample_id string, position int")


def test_build_places_values(spark, quant):
    got = M.build_matrix(quant, sheet_of(spark, "a", "b", "c"), "counts")
    assert rows_as(got)[:4] == [("a", "ENSG0.1", 10), ("a", "ENSG1.1", 20), ("a", "ENSG2.1", 30), ("b", "ENSG0.1", 11)]
    tpm = M.build_matrix(quant, sheet_of(spark, "a", "b", "c"), "tpm")
    assert tpm.agg(F.sum("value")).first()[0] == pytest.approx(189 / 2)


def test_duplicate_strategies(spark, quant):
    sheet = sheet_of(spark, "a", "a", "b")
    with pytest.raises(ValueError, match="several files"):
        M.build_matrix(quant, sheet, "counts")
    deepest = M.build_matrix(quant, sheet, "counts", "deepest").where("sample_id = 'a'")
    assert deepest.agg(F.sum("value")).first()[0] == 63
    first = M.build_matrix(quant, sheet, "counts", "first").where("sample_id = 'a'")
    assert first.agg(F.sum("value")).first()[0] == 60
    with pytest.raises(ValueError, match="unknown strategy"):
        M.build_matrix(quant, sheet, "counts", "longest")


def test_equal_depth_takes_the_first_file(spark, quant):
    same = quant.withColumn("unstranded", F.lit(5).cast("bigint"))
    files = M.file_totals(same.select(F.col("file_name").alias("file"), F.col("unstranded").alias("value")))
    files = files.withColumn("sample_id", F.lit("a"))
    assert M.chosen_files(files, "deepest").first()["file"] == f"u0{SUFFIX}"


def test_build_errors(spark, quant):
    with pytest.raises(ValueError, match="without a sample sheet row"):
        M.build_matrix(quant, sheet_of(spark, "a", "b"), "counts")
    with pytest.raises(ValueError, match="unknown metric"):
        M.build_matrix(quant, sheet_of(spark, "a", "b", "c"), "depth")
    features = quant.select(F.col("gene_id").alias("feature_id"), "gene_type").distinct()
    with pytest.raises(ValueError, match="lncRNA"):
        M.build_matrix(quant, sheet_of(spark, "a", "b", "c"), "counts", biotype="tRNA", features=features)
    kept = M.build_matrix(quant, sheet_of(spark, "a", "b", "c"), "counts", biotype="protein_coding", features=features)
    assert kept.select("feature_id").distinct().count() == 2
    assert resolve_metric("raw_counts") == "unstranded"


def test_mirna_defaults_to_reads_per_million(spark):
    quant = spark.createDataFrame([("m.mirnas.quantification.txt", "hsa-mir-21", 5, 2.5)],
                                  "file_name string, miRNA_ID string, read_count bigint, reads_per_million_miRNA_mapped double")
    sheet = spark.createDataFrame([("m.mirnas.quantification.txt", "s", 0)], "file_name string, sample_id string, position int")
    assert rows_as(M.build_matrix(quant, sheet, modality=MIRNA)) == [("s", "hsa-mir-21", 2.5)]


def test_incomplete_matrix_is_an_error(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", float("nan"))],
                               "sample_id string, feature_id string, value double")
    rows = {r["sample_id"]: r for r in M.matrix_checks(df).collect()}
    assert rows["a"]["complete"] and not rows["b"]["complete"] and rows["b"]["n_non_finite"] == 1
    with pytest.raises(ValueError, match="not complete"):
        M.assert_matrix(df)


def wide(cells):
    return cells.groupBy("sample_id").pivot("feature_id").agg(F.first("value")).toPandas().set_index("sample_id")


def test_pca_matches_svd(dataset):
    _, cells = dataset
    x = np.log2(wide(cells) + 1)
    x = x[x.var(ddof=0).sort_values(ascending=False).index[:30]]
    z = (x - x.mean()) / x.std(ddof=0)
    s = np.linalg.svd(z, compute_uv=False)
    variance, scores = K.pca(cells, 5, 30)
    got = [r["var_pct"] for r in variance.orderBy("pc").collect()]
    assert np.allclose(got, 100 * (s ** 2 / (s ** 2).sum())[:5])
    pc1 = scores.toPandas().set_index("sample_id").pc1.loc[z.index]
    assert np.isclose((pc1 ** 2).sum(), s[0] ** 2)


def test_rank_correlation_matches_numpy(dataset):
    _, cells = dataset
    got = K.rank_correlation(cells, 6).toPandas()
    names = sorted(got.feature_a.unique())
    ranks = wide(cells)[names].rank()
    want = np.corrcoef(ranks.T)
    table = got.pivot(index="feature_a", columns="feature_b", values="rho").loc[names, names]
    assert np.allclose(table, want)


def test_eta_squared_extremes(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "y"), ("b", 5.0, "x"), ("b", 5.0, "y")], "g string, v double, h string")
    assert M.eta_squared(df, "v", "g").first()["eta_squared"] == pytest.approx(1.0)
    assert M.eta_squared(df, "v", "h").first()["eta_squared"] == pytest.approx(0.0)
    assert M.eta_squared(df.limit(2), "v", "g").first()["eta_squared"] is None
    assert M.eta_squared(df.withColumn("v", F.lit(3.0)), "v", "g").first()["eta_squared"] is None


def test_histogram_matches_numpy(dataset):
    _, cells = dataset
    x = np.log2(np.array([r[0] for r in cells.select("value").collect()]) + 1)
    counts, edges = np.histogram(x, 80)
    rows = {r["bin"]: r for r in M.histogram(cells).collect()}
    got = [rows[i]["n"] if i in rows else 0 for i in range(80)]
    assert sum(got) == len(x) and np.abs(np.array(got) - counts).sum() <= 2  # an edge may round
    assert rows[0]["bin_from"] == pytest.approx(edges[0]) and rows[79]["bin_to"] == pytest.approx(edges[-1])


def test_distribution_and_metric_names(spark, dataset):
    _, cells = dataset
    v = np.array([r[0] for r in cells.select("value").collect()])
    row = M.value_distribution(cells).first()
    assert row["median"] == pytest.approx(np.median(v)) and row["p75"] == pytest.approx(np.percentile(v, 75))
    assert row["zero_pct"] == pytest.approx(100 * (v == 0).mean()) and row["metric"] == "FPKM/other"
    whole = cells.withColumn("value", F.floor("value"))
    assert M.value_distribution(whole).first()["metric"] == "counts"
    tpm = cells.withColumn("value", F.lit(1e6 / N_FEATURES))
    assert M.value_distribution(tpm).first()["metric"] == "TPM"


def test_summary_report(dataset):
    _, cells = dataset
    parts = builds.matrix_summary(cells, components=3)
    assert parts["size"].first()["n_features"] == N_FEATURES and parts["size"].first()["biotype_filtered"]
    held = {r[0] for r in cells.select("feature_id").distinct().collect()}
    markers = parts["markers"].collect()
    assert parts["components"].count() == 3 and all(r["found"] == (r["base"] in held) for r in markers)
    assert 0 < sum(r["found"] for r in markers) < len(markers)
    assert {r["site"] for r in parts["sites"].collect()} == {"05", "38", "91"}


def test_modalities(spark):
    df = spark.createDataFrame([("ENSG1",), ("hsa-mir-1",), ("hsa-let-7",), ("hsa-miR-2",), ("case_id",)], "feature_id string")
    assert detect_modality(df) is MIRNA
    assert detect_modality(df.where("feature_id = 'case_id'")) is None
    assert detect_modality(df.where("feature_id in ('ENSG1', 'hsa-mir-1')")) is RNASEQ


def test_a_ragged_matrix_is_an_error(spark, quant):
    sheet = sheet_of(spark, "a", "b", "c")
    lacking = quant.where("not (file_name like 'u1%' and gene_id = 'ENSG1.1')")
    with pytest.raises(ValueError, match="not complete"):
        M.build_matrix(lacking, sheet, "counts")
    with pytest.raises(ValueError, match="not complete"):
        M.build_matrix(quant.withColumn("unstranded", F.expr("nullif(unstranded, 21)")), sheet, "counts")
    assert M.build_matrix(lacking, sheet, "counts", complete=False).count() == 8


def test_biotypes_come_from_the_files(spark, quant):
    kept = M.build_matrix(quant, sheet_of(spark, "a", "b", "c"), "counts", biotype="protein_coding")
    assert kept.select("feature_id").distinct().count() == 2


def test_one_fraction_among_many_features_counts(spark):
    cells = spark.range(60).selectExpr("'s' as sample_id", "lpad(cast(id as string), 3, '0') as feature_id",
                                       "if(id = 59, 1.5d, cast(id as double)) as value")
    assert M.whole_valued(cells).first()[0] is False
    assert M.whole_valued(cells.where("value <> 1.5")).first()[0] is True


def test_vectors_keep_positions(spark):
    from cohortmill.operators.components import sample_vectors

    cells = spark.createDataFrame([("a", "f1", 1.0), ("a", "f2", 2.0), ("b", "f2", 3.0), ("b", "f1", 4.0)],
                                  "sample_id string, feature_id string, value double")
    order = spark.createDataFrame([("f1", 0), ("f2", 1)], "feature_id string, position int")
    got = {r[0]: list(r[1]) for r in sample_vectors(cells, order, "value").collect()}
    assert got == {"a": [1.0, 2.0], "b": [4.0, 3.0]}
    for ragged in ("not (sample_id = 'b' and feature_id = 'f1')", "not (sample_id = 'b' and feature_id = 'f2')"):
        with pytest.raises(Exception, match="lacks selected features"):
            sample_vectors(cells.where(ragged), order, "value").collect()


def test_person_codes_keep_keys_apart(spark):
    from cohortmill.plans.adapters import person_code

    keys = spark.createDataFrame([(k,) for k in (0, 1, 35, 36, 9999, 10000, 10001, 1679615, 1679616, 10**12)], "k long")
    codes = [r[0] for r in keys.select(person_code(F.col("k"))).collect()]
    assert len(set(codes)) == len(codes) and min(map(len, codes)) == 4


def test_a_registered_build_is_checked(spark, monkeypatch):
    from cohortmill.operators import matrix as M
    from cohortmill.plans.registry import QUERIES

    checked, check = [], M.assert_matrix
    monkeypatch.setattr(M, "assert_matrix", lambda cells: checked.append(1) or check(cells))
    built = QUERIES["matrix_build_complete"](spark, "/root/testdata/sf0.001")
    assert checked and built.count() == built.select("sample_id").distinct().count() * built.select("feature_id").distinct().count()

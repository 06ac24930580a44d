import math

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import clinical as FC
from cohortmill.functions import fixed
from cohortmill.functions import identifiers as FI
from cohortmill.functions.numbers import finite, log2p1_clipped
from cohortmill.functions.probability import chi2_sf, erfc, normal_cdf, normal_quantile


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_file_stem(spark):
    names = ["u1.rna_seq.augmented_star_gene_counts.tsv", "/a/b/u2_rna_seq_augmented_star_gene_counts.tsv",
             "u3.parquet", "plain", ".hidden", "a.b.c", None]
    assert column(spark, names, FI.file_stem) == ["u1", "u2", "u3", "plain", ".hidden", "a.b", None]
    mirna = ["u.mirbase21.mirnas.quantification.txt", "u_mirbase21_mirnas_quantification.txt",
             "u.mirnas.quantification.txt"]
    assert column(spark, mirna, lambda c: FI.file_stem(c, fixed.MIRNA_FILE_SUFFIXES)) == ["u"] * 3


def test_stage_group(spark):
    stages = ["Stage IA", "Stage IIB", "Stage IIIA", "Stage IV", "Stage IVA", "Stage IVC", "Stage X", None]
    assert column(spark, stages, FC.stage_group) == ["I", "II", "III", "IV", "IV", "I", "Unknown", "Unknown"]
    groups = ["I", "II", "III", "IV", "Unknown", None]
    assert column(spark, groups, FC.stage_level) == [1, 2, 3, 4, None, None]


def test_sample_codes(spark):
    codes = ["01A", "02A", "06B", "11A", "20A", "XXA", "1", "", None, "00A"]
    assert column(spark, codes, FI.tissue_of_code) == [
        "Tumor", "Tumor", "Tumor", "Normal", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert column(spark, codes, FI.sample_type_of_code) == [
        "Primary Tumor", "Recurrent Tumor", "Tumor", "Solid Tissue Normal", "Other", "Unknown",
        "Unknown", "Unknown", "Unknown", "Other"]


def test_sites(spark):
    ids = ["TCGA-44-2666-01A", "tcga-05-1", "OTHR-05-1", "x", None]
    assert column(spark, ids, FI.site_code) == ["44", "05", "?", "?", "?"]
    assert column(spark, ids, lambda c: FI.site_code(c, strict=False)) == ["44", "05", "05", "?", "?"]


def test_missing_text(spark):
    raw = ["'--", "--", "None", "null", " a ", "", None, "-- x"]
    assert column(spark, raw, FC.canonical_text) == ["", "", "", "", "a", "", "", "-- x"]
    assert column(spark, ["67.9", "67", "x", None], FC.whole_number) == [67, 67, None, None]
    assert column(spark, ["67.9", "67", "x"], lambda c: FC.whole_number(c, False)) == [None, 67, None]


def test_gender_missing_is_not_male(spark):
    assert column(spark, ["male", "female", None], FC.is_male) == [1, 0, 0]


def test_clipped_log(spark):
    values = [3.0, -4.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(spark, values, log2p1_clipped, "double") == [2.0, 0, 0, 0, 0, 0]
    assert column(spark, values, finite, "double") == [3.0, -4.0, None, None, None, None]


def test_erfc(spark):
    xs = [-5.0, -1.0, 0.0, 1e-9, 0.2, 1.0, 3.0, 8.0, 20.0, 25.9]
    for got, x in zip(column(spark, xs, erfc, "double"), xs):
        assert got == pytest.approx(math.erfc(x), rel=1e-11)
    assert column(spark, [40.0, None], erfc, "double") == [0.0, None]


def test_chi2_and_normal(spark):
    # upper 5 % points from the standard tables
    for df, point in ((1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251179),
                      (6, 12.591587243743977)):
        assert column(spark, [point], lambda c: chi2_sf(c, df), "double")[0] == pytest.approx(0.05, abs=1e-9)
    assert column(spark, [1.959963984540054], normal_cdf, "double")[0] == pytest.approx(0.975, abs=1e-12)
    assert normal_quantile(0.8) == pytest.approx(0.8416212335729143)

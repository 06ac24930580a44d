"""Formats, word lists, limits and gene panels that results depend on."""

from __future__ import annotations

# --- fixed values: file formats -------------------------------------------------
RNA_COLUMNS = (
    "gene_id", "gene_name", "gene_type", "unstranded", "stranded_first", "stranded_second",
    "tpm_unstranded", "fpkm_unstranded", "fpkm_uq_unstranded",
)
RNA_COUNT_COLUMNS = ("unstranded", "stranded_first", "stranded_second")
RNA_SUMMARY_ROWS = ("N_unmapped", "N_multimapping", "N_noFeature", "N_ambiguous")
MIRNA_COLUMNS = ("miRNA_ID", "read_count", "reads_per_million_miRNA_mapped", "cross-mapped")

RNA_FILE_SUFFIXES = (
    ".rna_seq.augmented_star_gene_counts.tsv",
    "_rna_seq_augmented_star_gene_counts.tsv",
)
MIRNA_FILE_SUFFIXES = (
    ".mirbase21.mirnas.quantification.txt",
    "_mirbase21_mirnas_quantification.txt",
    ".mirnas.quantification.txt",
)

# --- fixed values: missing-value markers ----------------------------------------
QUANTIFICATION_NULLS = ("", "NA", "-")
SHEET_NULLS = ("", "NA")
CLINICAL_NULLS = ("", "NA", "'--", "--", "not reported", "Not Reported")

# --- fixed values: identifier patterns ------------------------------------------
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CASE_PATTERN = r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}$"
SAMPLE_PATTERN = r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-[0-9]{2}[A-Z]$"
ALIQUOT_PATTERN = (
    r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-[0-9]{2}[A-Z]-[0-9]{2}[A-Z]-[A-Z0-9]{4}-[0-9]{2}$"
)
SAMPLE_CODE_PATTERN = r"-([0-9]{2}[A-Z])$"
TISSUE_TYPES = ("Normal", "Tumor")
VITAL_STATUSES = ("Alive", "Dead")

# --- fixed values: metrics ------------------------------------------------------
RNA_METRICS = (
    "unstranded", "stranded_first", "stranded_second",
    "tpm_unstranded", "fpkm_unstranded", "fpkm_uq_unstranded",
)
MIRNA_METRICS = ("read_count", "reads_per_million_miRNA_mapped")
METRIC_ALIASES = {
    "tpm": "tpm_unstranded",
    "counts": "unstranded",
    "raw_counts": "unstranded",
    "fpkm": "fpkm_unstranded",
    "fpkm_uq": "fpkm_uq_unstranded",
}
FEATURE_TOTAL = 60660

# --- fixed values: cohort columns, stages, limits -------------------------------
COHORT_COLUMNS = (
    "sample_id", "case_id", "time", "event",
    "age_at_index", "gender", "ajcc_pathologic_stage", "tissue_type",
)
LABEL_COLUMNS = COHORT_COLUMNS[:7]
COVARIATES = ("age_at_index", "gender", "ajcc_pathologic_stage")
MAIN_STAGES = ("I", "II", "III", "IV")
DAYS_PER_YEAR = 365.25
COMPLETENESS_ERROR_BELOW = 0.20
COMPLETENESS_WARNING_BELOW = 0.90
ALPHA = 0.05
RIDGE_STEPS = (0.0, 0.1, 0.5, 1.0)
MIN_COX_ROWS = 20

# --- fixed values: gene panels --------------------------------------------------
SIGNATURE_PANEL = {
    "NKX2-1": ("ENSG00000136352", -1),
    "NAPSA": ("ENSG00000131400", -1),
    "SFTPC": ("ENSG00000168484", -1),
    "MKI67": ("ENSG00000148773", 1),
    "TOP2A": ("ENSG00000131747", 1),
    "BIRC5": ("ENSG00000089685", 1),
    "SPP1": ("ENSG00000118785", 1),
}
MARKER_GENES = {
    "EGFR": "ENSG00000146648",
    "KRAS": "ENSG00000133703",
    "TP53": "ENSG00000141510",
    "ALK": "ENSG00000171094",
    "ROS1": "ENSG00000047936",
    "NKX2-1": "ENSG00000136352",
    "SFTPC": "ENSG00000168484",
}

# --- fixed values: quality-rule categories --------------------------------------
MISSING_FILE = "missing_star_file"
ORPHAN_FILE = "orphan_star_file"
MISSING_CLINICAL = "missing_clinical"
DUPLICATE_SAMPLE = "duplicate_sample"
MISSING_SURVIVAL = "missing_survival"
SELF_HANDLED = (MISSING_CLINICAL, MISSING_SURVIVAL, ORPHAN_FILE, DUPLICATE_SAMPLE)

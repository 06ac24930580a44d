"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and once timed; results go to the noop sink, so every column
of every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "km_by_stratum", "km_statistics", "logrank_median_split", "logrank_strata",
    "split_screen_all_features", "signature_report", "fdr_q_values", "cox_clinical_effects",
    "concordance_of_score", "matrix_build_deepest", "matrix_checks", "value_distribution",
    "feature_statistics", "z_scores", "feature_ranks", "pca_components", "survival_dataset",
    "build_funnel", "quality_counts", "cell_comparison", "numeric_profile_by_group",
    "readiness_report", "scaled_training_cells", "clinical_job", "flatten_file_hits",
]


def main() -> None:
    from cohortmill.plans.registry import QUERIES
    from cohortmill.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g", spark__python__sql__dataFrameDebugging__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")

    cold, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        for times in (cold, warm):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

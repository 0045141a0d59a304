"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "numeric_profile", "numeric_profile_nulls", "schema_summary", "iqr_outliers", "correlation_pairs", "duplicate_rows",
    "categorical_top_values_orders", "missingness", "describe_sample_std", "type_inference", "validation_rules",
    "text_length_profile", "top_unigrams", "top_bigrams", "duplicate_texts", "char_makeup", "clean_words", "tfidf_weights",
    "impute_median", "scale_standard", "scale_robust", "label_encode", "split_random", "split_stratified",
    "class_report", "roc_auc_average_precision", "threshold_sweep", "regression_errors",
    "drift_numeric", "drift_by_window", "vector_topk", "image_headers",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from gristmill.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("numeric_profile", "correlation_pairs"):  # start the JVM code paths and Python workers
        QUERIES[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

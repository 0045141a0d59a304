"""spark-submit jobs/monitor_drift.py BASELINE FOLDER COLUMN TS OUT: drift of newly arrived Parquet files."""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from gristmill.core import ship_package
from gristmill.operators.drift import fit_baseline
from gristmill.sources.tables import read_table, write_report
from gristmill.streaming.incremental import read_drift, read_files, start_drift


def main() -> None:
    ap = argparse.ArgumentParser()
    for name in ("baseline", "folder", "column", "ts", "out"):
        ap.add_argument(name)
    ap.add_argument("--window", default="1 day")
    ap.add_argument("--lateness", default="1 hour")
    args = ap.parse_args()
    spark = SparkSession.builder.appName("monitor-drift").getOrCreate()
    ship_package(spark)
    baseline = read_table(spark, args.baseline)
    base = fit_baseline(baseline, args.column)
    stream = read_files(spark, args.folder, baseline.schema)
    bins = f"{args.out}/bins"
    start_drift(stream, base, args.ts, bins, f"{args.out}/state", width=args.window, lateness=args.lateness).awaitTermination()
    write_report(read_drift(spark, base, bins), f"{args.out}/drift")


if __name__ == "__main__":
    main()

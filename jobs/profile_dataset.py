"""spark-submit jobs/profile_dataset.py SOURCE OUT [--target C] [--text C]: report of a table, text column or image folder."""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from gristmill.core import ship_package
from gristmill.plans.reports import image_dataset_report, table_report, text_report
from gristmill.sources.files import detect_modality
from gristmill.sources.tables import read_table, suffix, write_report


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("source")
    ap.add_argument("out")
    ap.add_argument("--target")
    ap.add_argument("--text")
    args = ap.parse_args()
    spark = SparkSession.builder.appName("profile-dataset").getOrCreate()
    ship_package(spark)
    if not suffix(args.source) and detect_modality(spark, args.source) == "image":
        report = image_dataset_report(spark, args.source)
    else:
        df = read_table(spark, args.source)
        report = text_report(df, args.text, args.target) if args.text else table_report(df, args.target)
    write_report(report, args.out)


if __name__ == "__main__":
    main()

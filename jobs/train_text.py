"""spark-submit jobs/train_text.py TABLE TEXT TARGET MODEL_DIR --key COLUMN [...]"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from gristmill.core import ship_package
from gristmill.operators.explain import top_class_terms
from gristmill.plans.training import save_model, train_text_classifier
from gristmill.sources.tables import read_table, write_report


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("table")
    ap.add_argument("text")
    ap.add_argument("target")
    ap.add_argument("out")
    ap.add_argument("--key", nargs="+", required=True)
    args = ap.parse_args()
    spark = SparkSession.builder.appName("train-text").getOrCreate()
    ship_package(spark)
    got = train_text_classifier(read_table(spark, args.table), args.text, args.target, args.key)
    save_model(got.model, f"{args.out}/model")
    write_report(got.scores, f"{args.out}/scores")
    write_report(got.confusion, f"{args.out}/confusion")
    write_report(top_class_terms(got.model, spark), f"{args.out}/terms")


if __name__ == "__main__":
    main()

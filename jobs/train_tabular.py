"""spark-submit jobs/train_tabular.py TABLE TARGET MODEL_DIR --key COLUMN [...]"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from gristmill.core import ship_package
from gristmill.operators.split import parts, random_split
from gristmill.plans.reports import model_card
from gristmill.plans.training import run_leaderboard, save_model
from gristmill.sources.tables import read_table, write_report


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("table")
    ap.add_argument("target")
    ap.add_argument("out")
    ap.add_argument("--key", nargs="+", required=True)
    ap.add_argument("--test-share", type=float, default=0.2)
    args = ap.parse_args()
    spark = SparkSession.builder.appName("train-tabular").getOrCreate()
    ship_package(spark)
    df = read_table(spark, args.table)
    train, test = parts(random_split(df, args.key, args.test_share))
    board = run_leaderboard(train.drop(*args.key), test, args.target)
    save_model(board.models[board.best], f"{args.out}/model")
    write_report(board.table, f"{args.out}/leaderboard")
    write_report(model_card(train, test, args.target, board.table, board.best), f"{args.out}/card")


if __name__ == "__main__":
    main()

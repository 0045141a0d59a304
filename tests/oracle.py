"""Run named queries next to their SQL twins and compare rows, columns and types.

python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
    "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]",
    "array<float>": "FLOAT[]",
}


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    return repr(v)


def compare(spark, con, sf_dir, fn, sql):
    """None if equal, else a short text; plus the number of rows."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return None, len(got)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} != {sorted(rel.columns)}", len(got)
    types = dict(zip(rel.columns, map(str, rel.types)))
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if types != spark_types:
        return f"types { {c: (spark_types[c], types[c]) for c in cols if types[c] != spark_types[c]} }", len(got)
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first: {bad[0]}", len(got)
    return None, len(got)


def main():
    from pyspark.sql import SparkSession

    from gristmill.catalog import ORACLES, QUERIES

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    failed = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            problem, n = compare(spark, con, args.sf, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        failed += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {n} rows {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

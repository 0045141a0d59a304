import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(spark, data, **kw):
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(3)
    got = exact_quantiles(df, list(data), PROBS, **kw)
    for c, v in data.items():
        want = pd.Series(v, dtype=float).dropna().quantile(PROBS)
        assert got[c] == pytest.approx(list(want), rel=1e-14, abs=1e-12), c


def test_settled_at_once(spark):
    rng = np.random.default_rng(1)
    check(spark, {"a": rng.normal(size=500), "b": rng.integers(0, 5, 500).astype(float)})


def test_many_rounds(spark):
    """Few pivots and no rows to settle with: every rank is found by narrowing."""
    rng = np.random.default_rng(2)
    hot = np.where(rng.random(4000) < 0.4, 7.0, rng.lognormal(0, 3, 4000))
    check(spark, {"heavy": rng.lognormal(0, 5, 4000), "hot": hot, "const": np.full(4000, 3.0),
                  "neg": -rng.random(4000)}, settle_rows=20, sample_rows=50)


def test_nulls_and_all_null(spark):
    df = spark.range(10).select(
        F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("x"), F.lit(None).cast("double").alias("none")
    )
    got = exact_quantiles(df, ["x", "none"], [0.5])
    assert got == {"x": [4.5], "none": [None]}


def test_empty(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_partition_invariance(spark):
    df = spark.range(5000).select((F.hash("id") % 1000).alias("x"))
    a = exact_quantiles(df.coalesce(1), ["x"], PROBS, settle_rows=10, sample_rows=100)
    b = exact_quantiles(df.repartition(8), ["x"], PROBS)
    assert a == b


def test_infinite_values(spark):
    data = [float("-inf")] * 3 + [float(i) for i in range(50)] + [float("inf")] * 4
    df = spark.createDataFrame([(v,) for v in data], "x double").repartition(3)
    for options in ({}, {"settle_rows": 2, "sample_rows": 5}):
        got = exact_quantiles(df, ["x"], [0.0, 3 / 56, 0.5, 1.0], **options)["x"]
        assert got == [float("-inf"), 0.0, 25.0, float("inf")]

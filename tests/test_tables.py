import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill import core
from gristmill.operators import frequency, profile, quality, running


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(1, 1.0, True, "a", "2024-01-01 10:00:00", 5.0, None), (2, float("nan"), False, "b", "2024-03-01 00:00:00.5", 5.0, None),
         (2, None, None, None, None, 5.0, None), (1, 1.0, True, "a", "2024-01-01 10:00:00", 5.0, None)],
        "i long, f double, b boolean, s string, t string, const double, none double",
    ).withColumn("ts", F.col("t").try_cast("timestamp")).drop("t")


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_type_classes(mixed):
    got = {f.name: core.type_class(f.dataType) for f in mixed.schema}
    assert got == {"i": "int", "f": "float", "b": "bool", "s": "object", "const": "float", "none": "float", "ts": "datetime64"}


def test_nan_is_missing(mixed):
    got = rows(profile.missingness(mixed), "column")
    assert got["f"]["missing"] == 2 and got["f"]["missing_pct"] == 50.0 and got["none"]["missing"] == 4
    assert profile.rows_with_missing(mixed).first()["rows_with_any_missing"] == 4


def test_schema_and_duplicates(mixed):
    got = rows(profile.schema_summary(mixed), "column")
    assert got["s"]["nunique"] == 2 and got["none"]["nunique"] == 0 and got["f"]["null_count"] == 2
    assert profile.duplicate_summary(mixed).first()["duplicate_rows"] == 1


def test_datetime_text(mixed):
    r = profile.datetime_overview(mixed).first()
    assert (r["min"], r["max"]) == ("2024-01-01T10:00:00", "2024-03-01T00:00:00.500000")


def test_numeric_profile(mixed):
    got = rows(profile.numeric_profile(mixed), "column")
    assert got["i"]["mean"] == 1.5 and got["i"]["p50"] == 1.5 and got["i"]["std"] == 0.5
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None and got["none"]["p50"] is None
    assert got["const"]["std"] == 0.0


def test_constant_columns_have_no_correlation(mixed):
    assert profile.correlation_pairs(mixed).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert profile.table_shape(df).first()["rows"] == 0
    assert profile.numeric_profile(df).first()["count"] == 0
    assert profile.duplicate_summary(df).first()["duplicate_rows_pct"] == 0.0
    assert rows(profile.missingness(df), "column")["x"]["missing_pct"] == 0.0
    assert profile.categorical_profile(df).count() == 0
    assert profile.numeric_profile(df.select("s")).count() == 0


@pytest.mark.parametrize("width", [2, 9])
def test_wide_correlation_equals_pairs(spark, width):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, width))
    data[:, 1] += data[:, 0]
    data[rng.random(data.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(data.shape[1])])
    pdf["flat"] = 0.1
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in
           profile.correlation_matrix(core.clean_nan(spark.createDataFrame(pdf).repartition(3)), list(pdf.columns)).collect()}
    want = pdf.corr()
    assert not any("flat" in k for k in got)
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], abs=1e-12)
    assert len(got) == math.comb(data.shape[1], 2)


def test_outlier_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    assert profile.iqr_outliers(df).first()["outliers_high"] == 1
    # 4 - 1.5 * 2 = 1: everything above 1
    assert profile.iqr_outliers(df, fence="reference").first()["outliers_high"] == 4


def test_tied_long_values_rank_by_text(spark):
    df = spark.createDataFrame([("é" * 70 + c,) for c in "hgfedcba"], "t string")
    assert [r["value"][-1] for r in frequency.top_values(df, ["t"], 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_long_values_come_back(spark):
    """Long strings are counted by fingerprint, winners get their text back."""
    text = "x" * 200
    df = spark.createDataFrame([(text, "a")] * 3 + [("short", "b"), (None, "b")], "t string, u string")
    got = [(r["column"], r["value"], r["n"]) for r in frequency.top_values(df, ["t", "u"], 2).orderBy("column", "rank").collect()]
    assert got == [("t", text, 3), ("t", "short", 1), ("u", "a", 3), ("u", "b", 2)]


def test_topk_is_limited_before_the_shuffle(spark):
    df = frequency.top_per_group(spark.range(100).select((F.col("id") % 3).alias("g"), "id"), ["g"], [F.col("id")], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and df.count() == 6


def test_target_preview(spark):
    df = spark.range(40).select((F.col("id") % 20).alias("y"), F.when(F.col("id") < 30, "a").when(F.col("id") < 39, "b").alias("c"))
    got = {r["metric"]: r["value"] for r in profile.target_preview(df, "y").collect()}
    assert got["p50"] == 9.5 and got["count"] == 40
    cls = {(r["metric"], r["key"]): r["value"] for r in profile.target_preview(df, "c").collect()}
    assert cls[("n_classes", None)] == 2 and cls[("class_count", "NaN")] == 1 and cls[("imbalance_ratio", None)] == 30
    assert profile.target_preview(df, "absent").count() == 0


def test_autodetect_target(spark):
    df = spark.range(50).select(F.col("id").alias("Label"), F.lit("x").alias("last"))
    assert profile.autodetect_target(df) == ("Label", False)
    assert profile.autodetect_target(df.select("Label", "last").withColumnRenamed("Label", "k")) == ("last", True)


def test_running_totals_two_levels(spark):
    rng = np.random.default_rng(3)
    v = np.unique(np.concatenate([rng.lognormal(0, 3, 500), rng.random(500) * 1e-6]))
    df = spark.createDataFrame(pd.DataFrame({"g": ["a", "b"] * (len(v) // 2) + ["a"] * (len(v) % 2), "v": v, "n": 1}))
    for down in (False, True):
        small = running.running_totals(df, "v", ["n"], groups=["g"], descending=down)
        large = running.running_totals(df, "v", ["n"], groups=["g"], descending=down, bucket_rows=37)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
        plain = df.toPandas().sort_values("v", ascending=not down)
        plain["n_upto"] = plain.groupby("g")["n"].cumsum()
        told = {(r["g"], r["v"]): r["n_upto"] for r in small.collect()}
        assert told == {(r.g, r.v): r.n_upto for r in plain.itertuples()}


def test_type_inference(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-05", "Jan 2 2024", "x")] * 19 + [("x", "junk", None, "1")], "n string, d string, m string, t string")
    out = quality.infer_and_coerce(df)
    kinds = dict(out.dtypes)
    assert (kinds["n"], kinds["d"], kinds["m"], kinds["t"]) == ("double", "timestamp", "timestamp", "string")
    assert out.where("n IS NULL").count() == 1 and out.where("m IS NULL").count() == 1
    assert dict(quality.infer_and_coerce(df.select("m"), try_datetime=False).dtypes)["m"] == "string"


def test_range_check_of_text(spark):
    df = spark.createDataFrame([("positive",), ("negative",)] * 10, "sentiment string")
    assert quality.range_check(df, "sentiment", 0, 1).first().asDict() == {
        "column": "sentiment", "min": 0.0, "max": 1.0, "n_total": 20, "n_within": None}


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError):
        quality.drop_columns(spark.range(1), "absent")

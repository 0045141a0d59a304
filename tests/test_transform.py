"""Power transform, bins, variance threshold and ordinals against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gristmill.operators import prep, transform


def yeo_johnson(x, e):
    up = np.log1p(np.maximum(x, 0)) if e == 0 else ((np.maximum(x, 0) + 1) ** e - 1) / e
    down = -np.log1p(np.maximum(-x, 0)) if e == 2 else -((np.maximum(-x, 0) + 1) ** (2 - e) - 1) / (2 - e)
    return np.where(x >= 0, up, down)


def likelihood(x, e, method):
    y = yeo_johnson(x, e) if method == "yeo_johnson" else np.log(x) if e == 0 else (x**e - 1) / e
    slope = np.sign(x) * np.log1p(np.abs(x)) if method == "yeo_johnson" else np.log(x)
    return -len(x) / 2 * math.log(y.var()) + (e - 1) * slope.sum()


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    data = {"heavy.tail": rng.lognormal(0, 1, 400), "both": rng.normal(0, 3, 400) ** 3, "even": rng.normal(50, 2, 400)}
    rows = list(zip(range(400), *(map(float, v) for v in data.values()), [1.5] * 400)) + [(900, None, float("nan"), None, 1.5)]
    return data, spark.createDataFrame(rows, "id long, `heavy.tail` double, both double, even double, flat double").repartition(3)


@pytest.mark.parametrize("method", ["yeo_johnson", "box_cox"])
def test_exponents_are_the_likeliest(skewed, method):
    data, df = skewed
    cols = [c for c in data if method == "yeo_johnson" or (data[c] > 0).all()]
    for c, e in transform.PowerTransform(cols, method).exponents(df).items():
        here = likelihood(data[c], e, method)
        assert all(here >= likelihood(data[c], e + step, method) - 1e-6 for step in (-0.5, -0.01, -1e-4, 1e-4, 0.01, 0.5)), c


def test_power_transform_is_saved(spark, skewed, tmp_path):
    data, df = skewed
    model = PipelineModel([transform.PowerTransform([*data, "flat"]).fit(df)])
    prep.save_pipeline(model, str(tmp_path / "m"))
    got = prep.load_pipeline(str(tmp_path / "m")).transform(df).orderBy("id").toPandas()
    e = transform.PowerTransform(["heavy.tail"]).exponents(df)["heavy.tail"]
    y = yeo_johnson(data["heavy.tail"], e)
    assert np.allclose(got["heavy.tail"][:400], (y - y.mean()) / y.std()) and got[[*data]].iloc[-1].isna().all()
    assert abs(got["both"][:400].mean()) < 1e-9 and abs(got["both"][:400].std(ddof=0) - 1) < 1e-9 and (got["flat"].abs() < 1e-9).all()
    assert transform.PowerTransform(["x"]).exponents(spark.createDataFrame([], "x double")) == {"x": 1.0}
    raw = transform.PowerTransform(["both"], standardize=False).fit(df).transform(df)
    assert raw.where("both is not null").count() == 400 and raw.columns[-1] == "both"


@pytest.mark.parametrize("strategy", ["uniform", "quantile", "kmeans"])
def test_bins(spark, strategy):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(m, 0.3, 60) for m in (0, 5, 9)] + [np.full(40, 5.0)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(999, None), (998, float("nan"))], "id long, `v.x` double").repartition(4)
    model = transform.KBins(["v.x"], 3, strategy)
    edges = model.edges(df)["v.x"]
    got = {r["id"]: r["v.x"] for r in model.fit(df).transform(df).collect()}
    assert got[999] is None and got[998] is None and len(edges) == 2
    assert [got[i] for i in range(len(v))] == [sum(x >= e for e in edges) for x in v]
    if strategy == "uniform":
        assert edges == pytest.approx([v.min() + np.ptp(v) / 3, v.min() + 2 * np.ptp(v) / 3])
    elif strategy == "quantile":
        assert edges == pytest.approx(list(np.quantile(v, [1 / 3, 2 / 3])))
    else:  # three groups far apart: centres are their means, and stay
        assert [got[i] for i in (0, 70, 130)] == [0, 1, 2]
        means = [v[[i for i in range(len(v)) if got[i] == b]].mean() for b in range(3)]
        assert edges == pytest.approx([(a + b) / 2 for a, b in zip(means, means[1:])])


def test_bins_of_few_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "x double")
    assert [r.x for r in transform.KBins(["x"], 5).fit(df).transform(df).collect()].count(0) >= 3
    for strategy in ("uniform", "quantile", "kmeans"):
        assert transform.KBins(["x"], 3, strategy).fit(df.limit(0)).transform(df).agg(F.max("x")).first()[0] == 0
        assert transform.KBins(["x"], 3, strategy).edges(df.where("x = 1")) == {"x": []}
    hot = transform.KBins(["x"], 2, "uniform", encode="one_hot").fit(df).transform(df.union(df.selectExpr("null")).distinct())
    assert sorted(r[0] for r in hot.select(vector_to_array("x_bins")).collect()) == [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]]


def test_variance_threshold(spark):
    df = spark.createDataFrame([(1, 1.0, 5, None, "t"), (2, 1.5, 5, None, "t")], "a int, `b.c` double, d int, e double, t string")
    assert transform.VarianceThreshold(["a", "b.c", "d", "e"]).fit(df).transform(df).columns == ["a", "b.c", "t"]
    assert transform.VarianceThreshold(["a", "b.c", "d", "e"], 0.1).fit(df).transform(df).columns == ["a", "t"]


def test_ordinals(spark):
    df = spark.createDataFrame([("low",), ("it's high",), ("none",), (None,)], "`p.q` string")
    got = transform.OrdinalEncode({"p.q": ["low", "it's high"]}, unknown=None, missing=-2).fit(df).transform(df)
    assert [r[0] for r in got.collect()] == [0, 1, None, -2]
    assert transform.sorted_orders(df, ["p.q"]) == {"p.q": ["it's high", "low", "none"]}
    with pytest.raises(ValueError):
        transform.OrdinalEncode({"p": ["a", "a"]})


def test_one_hot_of_odd_names_and_values(spark):
    """Dotted names pass the whole preparation; a value that is called like a slot is a value."""
    rows = [("infrequent", 1.0)] * 4 + [("=x", 2.0)] * 3 + [("__infrequent__", 3.0)] * 2 + [("rare", 4.0)]
    df = spark.createDataFrame(rows, "`c.d` string, `n m` double")
    model = prep.OneHotVector(["c.d"], max_categories=3).fit(df)
    got = {r[0]: r[1] for r in model.transform(df).select("`c.d`", vector_to_array("`c.d_vec`")).distinct().collect()}
    assert got == {"=x": [1.0, 0.0, 0.0], "infrequent": [0.0, 1.0, 0.0], "__infrequent__": [0.0, 0.0, 1.0], "rare": [0.0, 0.0, 1.0]}
    pipeline, numeric, other = prep.build_preprocessor(df)
    out = pipeline.fit(df).transform(df)
    assert (numeric, other) == (["n m"], ["c.d"]) and sorted(out.columns) == ["c.d", "features", "n m"]
    assert len(out.select(vector_to_array("features")).first()[0]) == 5
    codes = prep.LabelEncode(["c.d"]).fit(df).transform(df)
    assert [r[0] for r in codes.select("`c.d`").distinct().orderBy("`c.d`").collect()] == [0, 1, 2, 3]


def test_rows_by_dotted_names(spark):
    from gristmill.operators import quality

    df = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "`a.b` int, `c.d` double")
    assert quality.top_rows(df, "c.d", 1, ["a.b"]).first()[0] == 1 and quality.first_rows(df, ["c.d"], 1).first()[0] == 3
    assert quality.table_preview(df, ["a.b"], 1).count() == 2


def test_exponents_of_one_split_are_searched_in_many_tasks(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * F.col("id") + 1.0).alias("x")).coalesce(1)
    whole = transform.PowerTransform(["x"]).exponents(df)
    tasks, plain = [], transform.PowerTransform.likelihoods
    monkeypatch.setattr(transform, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(transform.PowerTransform, "likelihoods", lambda self, rows, grid: tasks.append(rows.rdd.getNumPartitions()) or plain(self, rows, grid))
    assert transform.PowerTransform(["x"]).exponents(df)["x"] == pytest.approx(whole["x"]) and set(tasks) == {10}

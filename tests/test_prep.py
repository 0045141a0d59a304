import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gristmill.operators import prep, split
from gristmill.plans.features import build_features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(400), "x": rng.normal(5, 2, 400), "y": rng.lognormal(size=400),
                        "k": rng.choice(["a", "b", "c"], 400, p=[0.7, 0.2, 0.1]), "t": rng.choice(["red fox", "blue sky day"], 400)})
    pdf.loc[::10, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


def test_imputer_ties_and_all_null(spark):
    df = spark.createDataFrame([(2.0, None), (1.0, None), (1.0, None), (2.0, None), (None, None)], "x double, none double")
    stage = prep.ImputeNumbers(["x", "none"], "most_frequent").fit(df)
    assert sorted(r[0] for r in stage.transform(df).select("x").collect()) == [1, 1, 1, 2, 2]
    assert stage.transform(df).where("none IS NULL").count() == 5
    odd = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert prep.ImputeNumbers(["x"]).constants(odd) == {"x": 2.5}


def test_scaled_columns(table):
    pdf, df = table
    out = prep.prepare(df, missing="mean", scaling="standard", target="id").toPandas().sort_values("id")
    x = pdf["x"].fillna(pdf["x"].mean())
    assert out["x"].to_numpy() == pytest.approx(((x - x.mean()) / x.std(ddof=0)).to_numpy())
    assert abs(out["y"].mean()) < 1e-9 and out["y"].std(ddof=0) == pytest.approx(1)


def test_pipeline_saved_and_loaded(table, tmp_path):
    _, df = table
    pipeline, numeric, other = prep.build_preprocessor(df.drop("id"), prep.make_config("robust", max_ohe_categories=2))
    assert numeric == ["x", "y"] and other == ["k", "t"]
    model = pipeline.fit(df)
    prep.save_pipeline(model, str(tmp_path / "p"))
    again = prep.load_pipeline(str(tmp_path / "p"))
    a = model.transform(df).select("id", vector_to_array("features").alias("v")).orderBy("id").collect()
    b = again.transform(df).select("id", vector_to_array("features").alias("v")).orderBy("id").collect()
    assert a == b and len(a[0]["v"]) == 6
    unseen = df.limit(1).withColumn("k", F.lit("new")).withColumn("t", F.lit("red fox"))
    assert sum(again.transform(unseen).select(vector_to_array("features")).first()[0][4:]) == 1.0


def test_presets():
    assert prep.make_config("nothing") == prep.make_config("baseline")
    assert prep.make_config("minimal").scaler == "none" and prep.make_config("minimal", scaler="robust").scaler == "robust"


def test_one_hot_errors_and_drops(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    def vec(**o):
        return [tuple(r[0]) for r in prep.OneHotVector(["v"], **o).fit(df).transform(df.where("v IS NOT NULL"))
                .select(vector_to_array("v_vec")).collect()]
    assert vec() == [(1, 0), (0, 1)] and vec(drop="if_binary") == [(0,), (1,)]
    assert vec(drop="first", handle_unknown="error") == [(0,), (1,)]
    strict = prep.OneHotVector(["v"], handle_unknown="error").fit(df.where("v IS NOT NULL"))
    with pytest.raises(Exception):
        strict.transform(spark.createDataFrame([("z",)], "v string")).collect()


def test_one_hot_cap_at_any_number_of_values(spark, tmp_path, monkeypatch):
    from gristmill import core

    monkeypatch.setattr(core.bounded_values, "__defaults__", (50,))
    df = spark.range(400).select(F.when(F.col("id") < 100, "it's").when(F.col("id") < 150, "b").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("v"),
                                 F.concat(F.lit("w"), F.col("id") % 90).alias("w"), "id")
    model = prep.OneHotVector(["v", "w"], max_categories=3).fit(df)
    asked = spark.createDataFrame([("b", "w1"), ("it's", "w0"), ("v200", "w80"), ("new", "new")], "v string, w string")
    first = tmp_path / "one"
    prep.save_pipeline(model, str(first))
    prep.save_pipeline(prep.load_pipeline(str(first)), str(first))
    for m in (model, prep.load_pipeline(str(first))):
        rows = m.transform(asked).select("v", *[vector_to_array(c).alias(c) for c in ("v_vec", "w_vec")]).collect()
        got = sorted((tuple(r["v_vec"]), tuple(r["w_vec"])) for r in rows)
        assert got == sorted([((1, 0, 0), (0, 1, 0)), ((0, 1, 0), (1, 0, 0)), ((0, 0, 1), (0, 0, 1)), ((0, 0, 0), (0, 0, 0))])
    assert all(len(s.getStatement()) < 2000 for s in model.stages if hasattr(s, "getStatement"))


def test_label_codes_of_many_values(spark):
    df = spark.createDataFrame([(f"v{i % 97:03d}" if i % 5 else None,) for i in range(1000)], "s string")
    got = {r["value"]: r["code"] for r in prep.label_codes(df, "s").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and "nan" in got
    model = prep.LabelEncode(["s"]).fit(df)
    assert model.transform(df).distinct().count() == len(got)


def test_components_match_numpy(table):
    pdf, df = table
    full = pdf.dropna()
    x = full[["x", "y"]].to_numpy() - full[["x", "y"]].to_numpy().mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    vt *= np.sign(vt[np.arange(2), np.abs(vt).argmax(axis=1)])[:, None]
    clean = df.where("NOT isnan(x)")
    out = prep.PrincipalComponents(["x", "y"]).fit(clean).transform(clean).orderBy("id").toPandas()
    assert out[["PCA1", "PCA2"]].to_numpy() == pytest.approx(x @ vt.T)


def test_split_sizes_and_determinism(table):
    _, df = table
    a = split.random_split(df, ["id"], 0.23)
    assert a.where("split = 'test'").count() == 92
    b = split.random_split(df.coalesce(1), ["id"], 0.23)
    assert sorted(map(tuple, a.select("id", "split").collect())) == sorted(map(tuple, b.select("id", "split").collect()))
    counts = {(r["k"], r["split"]): r["count"] for r in split.random_split(df, ["id"], 0.2, stratify="k").groupBy("k", "split").count().collect()}
    for k in "abc":
        total = counts[(k, "test")] + counts[(k, "train")]
        assert counts[(k, "test")] == round(total * 0.2)
    assert split.sample_rows(df, 50, ["id"]).count() == 50 and split.sample_rows(df, 1000, ["id"]).count() == 400


def test_split_keeps_copies_together(spark):
    df = spark.range(900).select((F.when(F.col("id") < 300, 0).otherwise(F.col("id"))).alias("key"))
    out = split.random_split(df, ["key"], 0.2).where("key = 0").select("split").distinct()
    assert out.count() == 1


def test_feature_build(table):
    _, df = table
    full = df.where("NOT isnan(x)")
    out = build_features(full, "k", ["id"], polynomial=True, pca=True, tfidf=True, components=3)
    assert set(out.train.columns) == {"id", "k", "PCA1", "PCA2", "PCA3", "t_tfidf"}
    assert out.train.count() + out.test.count() == full.count()
    assert out.train.join(out.test, "id", "inner").count() == 0

import math

import pytest
from pyspark.sql import functions as F

from gristmill.operators import explain, split
from gristmill.plans import reports, training

LIGHT = {"trees": 5, "depth": 4, "rounds": 2, "iterations": 20}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(600).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), (F.hash("id") % 5).cast("double").alias("noise"),
        F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("g"),
    ).withColumn("big", F.when(F.col("x") > 3, "high").otherwise("low")).withColumn("num", F.col("x") * 3 + F.when(F.col("g") == "u", 10).otherwise(0))


def test_classification_board_and_saved_scoring(spark, rows, tmp_path):
    train, test = split.parts(split.random_split(rows.drop("num"), ["id"], 0.25))
    board = training.run_leaderboard(train.drop("id"), test, "big", **LIGHT)
    assert board.task == "classification" and set(board.models) == {"LogReg", "RandomForest", "BoostedTrees"}
    assert board.table.first()["accuracy"] == 1.0
    training.save_model(board.models[board.best], str(tmp_path / "m"))
    assert training.evaluate_model(str(tmp_path / "m"), test, "big").first()["accuracy"] == 1.0
    full = training.full_evaluation(str(tmp_path / "m"), test, "big")
    found = {r["metric"]: r["value"] for r in full.scores.collect()}
    assert found["accuracy"] == found["auc"] == found["ap"] == 1.0
    told = training.score_table(str(tmp_path / "m"), test).select("big", "probability").collect()
    losses = [-math.log(r["probability"][["high", "low"].index(r["big"])]) for r in told]
    assert found["log_loss"] == pytest.approx(sum(losses) / len(losses))
    assert full.confusion.where("y_true = y_pred").agg({"n": "sum"}).first()[0] == 150 and full.report.count() == 5
    card = reports.model_card(train, test, "big", board.table, board.best).first()["card"]
    assert '"test_rows":150' in card and '"accuracy":1.0' in card
    drops = {r["feature"]: r["drop"] for r in explain.permutation_importance(
        board.models["RandomForest"], test, "big", ["x", "noise"], ["id"]).collect()}
    assert drops["x"] > 0.2 and abs(drops["noise"]) < 0.05
    weights = explain.model_importance(board.models["RandomForest"], test).first()
    assert weights["feature"] == "x" and weights["importance"] > 0.5


def test_regression_board(rows):
    train, test = split.parts(split.random_split(rows.drop("big", "noise"), ["id"], 0.25))
    board = training.run_leaderboard(train.drop("id"), test, "num", task="regression", boosted=False, **LIGHT)
    assert board.best == "Linear" and board.table.first()["r2"] == pytest.approx(1.0)
    full = training.full_evaluation(board.models["Linear"], test, "num")
    assert full.confusion is None and full.scores.where("metric = 'r2'").first()["value"] == pytest.approx(1.0)


@pytest.mark.parametrize("classes", [2, 3])
def test_text_classifier(spark, classes):
    words = ["good fine great", "bad poor awful", "so la ti"]
    df = spark.createDataFrame([(i, f"{words[i % classes]} item {i}", f"c{i % classes}") for i in range(120)], "id long, t string, y string")
    got = training.train_text_classifier(df, "t", "y", ["id"], iterations=20)
    assert got.scores.first()["accuracy"] == 1.0 and got.confusion.count() == classes**2
    top = {r["term"] for r in explain.top_class_terms(got.model, spark, 3).where("label = 'c0'").collect()}
    assert top & {"good", "fine", "great", "good fine", "fine great"}


def test_model_queries_run_at_the_defaults(spark, monkeypatch):
    from gristmill.catalog import models

    class Asked(Exception):
        pass

    def asked(*a, **options):
        raise Asked(options)

    monkeypatch.setattr(models.M, "run_leaderboard", asked)
    monkeypatch.setattr(models.M, "train_text_classifier", asked)
    for name in ("leaderboard_classification", "leaderboard_regression", "permutation_importance", "text_classifier_scores", "text_classifier_terms"):
        with pytest.raises(Asked) as got:
            getattr(models, name)(spark, "/root/testdata/sf0.001")
        assert not {"trees", "depth", "rounds", "iterations"} & set(got.value.args[0]), name


def test_training_rows_of_one_split_are_dealt(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from gristmill import core

    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    one = spark.range(600).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 2 + 0.0).alias("label")).coalesce(1)
    held = [training._training_tasks(one, 600).rdd.glom().map(lambda rows: [int(r["features"][0]) for r in rows]).collect() for _ in range(2)]
    cores = spark.sparkContext.defaultParallelism
    assert len(held[0]) == -(-6 // cores) * cores and max(map(len, held[0])) <= 110 and held[0] == held[1]
    assert sorted(i for task in held[0] for i in task) == list(range(600))
    assert training._training_tasks(one.repartition(3), 80).rdd.getNumPartitions() == 1
    assert core.dealt(one, 100).rdd.getNumPartitions() == 6 and core.dealt(one, 600).rdd.getNumPartitions() == 1


def _ready(spark, label):
    """Vectors of a number and a category in few cells."""
    from gristmill.operators.prep import build_preprocessor, make_config

    df = spark.range(900).select(
        (F.hash("id") % 40).cast("double").alias("x"), F.concat(F.lit("g"), F.pmod(F.hash("id", F.lit(1)), F.lit(3))).alias("g"),
        F.pmod(F.hash("id", F.lit(2)), F.lit(17)).cast("double").alias("z"),
    ).withColumn("label", label)
    pipeline, _, _ = build_preprocessor(df.select("x", "g"), make_config(numeric_cols=("x",), categorical_cols=("g",)))
    return pipeline.fit(df).transform(df).select("features", "label").coalesce(1).cache()


@pytest.mark.parametrize("classes", [True, False])
def test_trees_of_cells_are_those_of_mllib(spark, classes):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from gristmill.operators import trees

    told = F.col("x") + 2 * F.col("z") + F.when(F.col("g") == "g1", F.col("x")).otherwise(5)
    ready = _ready(spark, (told > 20).cast("double") if classes else told)
    kinds = (GBTClassifier, RandomForestClassifier) if classes else (GBTRegressor, RandomForestRegressor)
    cells = trees.find_cells(ready, 900, classification=classes, max_bins=100)
    assert cells.counts.sum() == 900 and len(cells.bins) < 900
    for e in (kinds[0](maxIter=6, maxBins=100, seed=1), kinds[1](numTrees=1, bootstrap=False, maxDepth=4, maxBins=100, seed=1)):
        mllib, own = e.fit(ready), trees.fit_trees(e, ready, cells)
        assert type(own) is type(mllib) and own.treeWeights == mllib.treeWeights and own.getMaxDepth() == mllib.getMaxDepth()
        for a, b in zip(mllib.transform(ready).collect(), own.transform(ready).collect(), strict=True):
            assert a["prediction"] == pytest.approx(b["prediction"])
            if classes:
                assert a["probability"].toArray() == pytest.approx(b["probability"].toArray())


def test_forest_draws_rows_one_by_one(spark):
    from pyspark.ml.regression import RandomForestRegressor

    from gristmill.operators import trees

    ready = _ready(spark, F.col("x") + F.col("z"))
    cells = trees.find_cells(ready, 900, classification=False)
    totals = {}
    for replace in (True, False):
        drawn = trees._drawn_sums(ready, cells, 60, 1.0 if replace else 0.9, replace, 7).collect()
        totals[replace] = [trees.np.frombuffer(bytes(r["sums"])).reshape(-1, 3)[:, 0].sum() for r in drawn]
    assert trees.np.std(totals[True]) == pytest.approx(30, rel=0.5)  # of 900 Poisson draws; drawing whole cells spreads further
    assert trees.np.mean(totals[False]) == pytest.approx(810, rel=0.02) and trees.np.std(totals[False]) == pytest.approx(9, rel=0.5)
    forest = RandomForestRegressor(numTrees=30, maxDepth=6, featureSubsetStrategy="all", seed=3)
    own, mllib = (m.transform(ready).selectExpr("avg(power(prediction - label, 2))").first()[0] for m in (trees.fit_trees(forest, ready, cells), forest.fit(ready)))
    assert own == pytest.approx(mllib, rel=0.1)


@pytest.mark.parametrize("target", ["big", "num"])
def test_rounds_of_boosting_are_no_scans(spark, rows, target):
    train, test = split.parts(split.random_split(rows.drop({"big": "num", "num": "big"}[target]), ["id"], 0.25))
    task, context, jobs = {"big": "classification", "num": "regression"}[target], spark.sparkContext, {}
    for rounds in (2, 12):
        context.setJobGroup(f"{target}-{rounds}", "board")
        training.run_leaderboard(train.drop("id"), test, target, task=task, trees=2, depth=2, rounds=rounds, iterations=2)
        jobs[rounds] = len(context.statusTracker().getJobIdsForGroup(f"{target}-{rounds}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[12] <= jobs[2] + 2


def test_importance_is_that_of_the_whole_board(spark, monkeypatch):
    from gristmill.catalog import models

    class Asked(Exception):
        pass

    def asked(*a, **options):
        raise Asked(options)

    monkeypatch.setattr(models.M, "run_leaderboard", asked)
    monkeypatch.setattr(models, "members", lambda spark, _: spark.range(40).selectExpr("id AS c_custkey", "if(id % 2 = 0, 'yes', 'no') AS industrial"))
    with pytest.raises(Asked) as got:
        models.permutation_importance(spark, "")
    assert got.value.args[0].get("boosted", True)

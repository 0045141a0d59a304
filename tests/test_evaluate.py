import numpy as np
import pandas as pd
import pytest

from gristmill.operators import drift, evaluate, explain, retrieve

Y = [1, 0, 1, 1, 0, 0, 1, 0]
P = [0.9, 0.8, 0.8, 0.6, 0.6, 0.3, 0.3, 0.1]


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame(list(zip(Y, [int(p >= 0.5) for p in P], P)), "y int, yp int, p double")


def test_tied_scores(tied):
    r = evaluate.curve_scores(tied, "y", "p").first()
    assert r["auc"] == pytest.approx(0.71875) and r["ap"] == pytest.approx(0.7095238095238094)


def brute_auc(y, p):
    pos, neg = [s for s, t in zip(p, y) if t], [s for s, t in zip(p, y) if not t]
    return np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])


def test_auc_is_the_pairwise_definition_on_both_plans(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    for options in ({}, {"small": False, "bucket_rows": 7}):
        assert evaluate.curve_scores(df, "y", "p", **options).first()["auc"] == pytest.approx(brute_auc(y, p))


def test_roc_points(tied):
    full = evaluate.roc_curve(tied, "y", "p", drop_intermediate=False).orderBy("threshold").collect()
    assert len(full) == 6 and (full[-1]["fpr"], full[-1]["tpr"]) == (0.0, 0.0) and (full[0]["fpr"], full[0]["tpr"]) == (1.0, 1.0)
    kept = {r["threshold"] for r in evaluate.roc_curve(tied, "y", "p").collect()}
    # steps (pos, neg) by falling score: (1,0) (1,1) (1,1) (1,1) (0,1); the middle ones are on one line
    assert kept == {float("inf"), 0.9, 0.3, 0.1}
    assert len(evaluate.pr_curve(tied, "y", "p").collect()) == 6


def test_class_scores(tied):
    r = evaluate.classification_scores(tied, "y", "yp", pos_label=1).first()
    assert r["accuracy"] == 0.625 and r["specificity"] == 0.5
    tp, fp, fn, tn = 3, 2, 1, 2
    assert r["mcc"] == pytest.approx((tp * tn - fp * fn) / np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    assert sum(x["n"] for x in evaluate.confusion_matrix(tied, "y", "yp").collect()) == 8


def test_never_predicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "c")], "y string, p string")
    got = {r["label"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert got["b"]["precision"] == got["b"]["recall"] == got["b"]["f1"] == 0.0 and got["c"]["support"] == 0
    cells = evaluate.confusion_matrix(df, "y", "p").collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 3
    assert evaluate.confusion_matrix(df, "y", "p", true_labels_only=True).count() == 4


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0)], "y int, p double")
    assert evaluate.log_loss(df, "y", "p").first()[0] == pytest.approx(-np.log(np.finfo(float).eps) / 2)


def test_mismatched_probabilities_give_nulls(spark):
    df = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.5, 0.5]), ("c", [0.5, 0.5])], "y string, p array<double>")
    assert evaluate.macro_curve_scores(df, "y", "p").first()["macro_auc"] is None
    assert evaluate.log_loss(df, "y", "p").first()[0] is None


def test_positive_column_choice(spark):
    df = spark.createDataFrame([("n", [0.9, 0.1]), ("y", [0.2, 0.8]), ("n", [0.6, 0.4])], "t string, p array<double>")
    assert evaluate.curve_scores(df, "t", "p").first()["auc"] == 1.0
    assert evaluate.curve_scores(df, "t", "p", pos_label="n").first()["label"] == "n"


def test_threshold_sweep(tied):
    got = {round(r["threshold"], 2): r for r in evaluate.threshold_sweep(tied, "y", "p").collect()}
    assert len(got) == 101 and got[0.0]["recall"] == 1.0 and got[0.95]["precision"] == 0.0
    assert got[0.6]["recall"] == 0.75 and got[0.6]["precision"] == 0.6
    few = evaluate.threshold_sweep(tied, "y", "p", [0.85, 0.2]).collect()
    assert [r["recall"] for r in few] == [1.0, 0.25]


def test_regression(spark):
    y, p = np.array([0.0, 1.0, -2.0, 4.0, 0.0]), np.array([0.0, 1.5, -1.0, 3.0, 2.0])
    r = evaluate.regression_scores(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", "p").first()
    assert r["mae"] == pytest.approx(np.abs(y - p).mean()) and r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r["mape"] == pytest.approx(np.mean([50, 50, 25])) and r["smape"] == pytest.approx(100 * np.mean([0.4, 2 / 3, 2 / 7, 2.0]))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.regression_scores(flat, "y", "p").first()["r2"] == 0.0


def test_task_rule(spark):
    assert evaluate.infer_task(spark.range(16), "id") == "regression"
    assert evaluate.infer_task(spark.range(15), "id") == "classification"
    assert evaluate.evaluate_supervised(spark.range(20).selectExpr("id as y", "id as p"), "y", "p").count() == 6


def test_drift_of_itself_is_zero(spark):
    df = spark.range(1000).selectExpr("id % 37 as x", "concat('c', id % 5) as c")
    for c in ("x", "c"):
        r = drift.drift(df, df, c).first()
        assert abs(r["psi"]) < 1e-9 and abs(r["kl"]) < 1e-9


def test_drift_with_absent_and_new_bins(spark):
    base = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "c string")
    now = spark.createDataFrame([("b",)] * 5 + [("z",)] * 5, "c string")
    assert drift.drift(base, now, "c").first()["psi"] == pytest.approx(drift.psi_of_shares([0, 0.5, 0.5], [0.6, 0.4, 0]))


def test_retrieval_in_several_passes(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(200, 6)), rng.normal(size=(9, 6))
    vec = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>").repartition(4)
    qs = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "q long, v array<double>")
    sims = (q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    for block in (100, 2):
        got = retrieve.top_k_similar(vec, "id", "v", qs, "q", "v", 3, queries_per_pass=block).collect()
        assert len(got) == 27
        for r in got:
            assert np.argsort(-sims[int(r["query_id"])])[r["rank"] - 1] == r["id"]


def test_retrieval_with_text_ids_and_zero_vectors(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("z", [0.0, 0.0]), ("n", None)], "id string, v array<double>")
    got = retrieve.top_k_similar(vec, "id", "v", vec, "id", "v", 5).collect()
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == [("a", "a", 1), ("a", "b", 2), ("b", "a", 2), ("b", "b", 1)]


def test_more_rounds_of_queries_move_no_more_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[200:] = x[:200]  # each vector comes twice
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    sims = np.round(retrieve._unit(x) @ retrieve._unit(x).T, retrieve.DIGITS)
    want = {(str(i), j, n) for i in range(400) for n, j in enumerate(np.argsort(-sims[i], kind="stable")[:3], 1)}
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data"))

    monkeypatch.setattr(retrieve, "FOUND", 50)
    held = []
    for block in (400, 40):
        before = shuffled()
        got = retrieve.top_k_similar(vec, "id", "v", vec, "id", "v", 3, queries_per_pass=block)
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want
        held.append(shuffled() - before)
    assert held[1] < held[0] + 400 * 64 * 4, held  # not one more copy of the vectors in ten rounds


def test_shuffled_column_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(explain, "ROWS_PER_BUCKET", 50)
    df = spark.range(2000).selectExpr("id", "id as v")
    out = explain.shuffled_column(df, "v", ["id"])
    assert sorted(r["v"] for r in out.collect()) == list(range(2000)) and out.where("v = id").count() < 40

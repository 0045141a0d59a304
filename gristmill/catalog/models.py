"""Model fitting and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import new_path
from ..operators import explain as X
from ..operators.profile import autodetect_target
from ..operators.split import parts, random_split
from ..plans import training as M
from ..plans.features import build_features
from .registry import query, rounded, table, union_sql
from .text import labelled


def segments(spark, sf_dir):
    """Orders with their customer's segment and balance; the status is the class to predict."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(customer, "o_custkey").select(
        "o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "o_orderpriority", "o_orderstatus"
    )


def members(spark, sf_dir):
    """All customers with the names of nation and region; whether they are in an industrial segment is to be told."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    where = nation.join(table(spark, sf_dir, "region"), "r_regionkey")
    industrial = F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "yes").otherwise("no")
    return table(spark, sf_dir, "customer").join(where, "c_nationkey").select("c_custkey", "c_acctbal", "n_name", "r_name", industrial.alias("industrial"))


def _board(spark, sf_dir, **options):
    train, test = parts(random_split(members(spark, sf_dir), ["c_custkey"], 0.2))
    return M.run_leaderboard(train.drop("c_custkey"), test, "industrial", **options), train, test


@query("leaderboard_classification")
def leaderboard_classification(spark, sf_dir):
    return _board(spark, sf_dir)[0].table


@query("leaderboard_regression")
def leaderboard_regression(spark, sf_dir):
    train, test = parts(random_split(members(spark, sf_dir), ["c_custkey"], 0.2))
    return M.run_leaderboard(train.drop("c_custkey"), test, "c_acctbal").table


@query("linear_regression_predictions", """
SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem)
  + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 3) AS prediction FROM lineitem""")
def linear_regression_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    pipeline, _, _ = M.build_preprocessor(rows, M.make_config(numeric_cols=("l_quantity",), categorical_cols=()))
    prepared = pipeline.fit(rows)
    fitted = M.LinearRegression(labelCol="l_extendedprice").fit(prepared.transform(rows))
    return rounded(M.score_table(M.PipelineModel([prepared, fitted]), rows).select("l_orderkey", "l_linenumber", "prediction"), 3)


@query("saved_model_scores", """
SELECT round(regr_r2(l_extendedprice, l_quantity), 3) AS r2, round(avg(abs(l_extendedprice - a - b * l_quantity)), 3) AS mae
FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)""")
def saved_model_scores(spark, sf_dir):
    """A linear model saved, loaded and scored on the rows it was fitted to."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    pipeline, _, _ = M.build_preprocessor(rows.drop("l_extendedprice"), M.make_config(numeric_cols=("l_quantity",), categorical_cols=()))
    prepared = pipeline.fit(rows)
    fitted = M.LinearRegression(labelCol="l_extendedprice").fit(prepared.transform(rows))
    path = new_path(spark, "model")
    M.save_model(M.PipelineModel([prepared, fitted]), path)
    found = M.full_evaluation(path, rows, "l_extendedprice").scores
    wide = found.groupBy().pivot("metric", ["r2", "mae"]).agg(F.first("value"))
    return rounded(wide, 3)


def _segment_model(spark, sf_dir):
    """A classifier that can be right on every row, saved; and the rows."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.upper("c_mktsegment").alias("named"))
    board = M.run_leaderboard(rows, rows, "c_mktsegment", boosted=False)
    path = new_path(spark, "model")
    M.save_model(board.models[board.best], path)
    return M.full_evaluation(path, rows, "c_mktsegment")


@query("saved_model_confusion", """
WITH s AS (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL)
SELECT a.v AS y_true, b.v AS y_pred, (SELECT count(*) FROM customer WHERE c_mktsegment = a.v AND a.v = b.v) AS n FROM s a, s b""")
def saved_model_confusion(spark, sf_dir):
    return _segment_model(spark, sf_dir).confusion


@query("saved_model_report", """
SELECT c_mktsegment AS label, 1.0::double AS precision, 1.0::double AS recall, 1.0::double AS f1, count(*) AS support FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1
UNION ALL SELECT 'accuracy', NULL, NULL, 1.0::double, count(c_mktsegment) FROM customer
UNION ALL SELECT unnest(['macro avg', 'weighted avg']), 1.0::double, 1.0::double, 1.0::double, (SELECT count(c_mktsegment) FROM customer)""")
def saved_model_report(spark, sf_dir):
    return rounded(_segment_model(spark, sf_dir).report)


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    board, _, test = _board(spark, sf_dir)
    return X.permutation_importance(board.models[board.best], test, "industrial", ["c_acctbal", "n_name", "r_name"], ["c_custkey"])


@query("shuffled_column", "SELECT count(*) AS rows, round(sum(l_quantity), 6) AS total, round(stddev_pop(l_quantity), 6) AS spread, true AS moved FROM lineitem")
def shuffled_column(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_quantity").alias("before"))
    out = X.shuffled_column(rows, "l_quantity", ["l_orderkey", "l_linenumber"])
    return rounded(out.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("total"), F.stddev_pop("l_quantity").alias("spread"),
        (F.count_if(F.col("l_quantity") != F.col("before")) > F.count(F.lit(1)) / 2).alias("moved"),
    ))


def _classifier(spark, sf_dir):
    return M.train_text_classifier(labelled(spark, sf_dir), "text", "quality", ["doc_id"])


@query("text_classifier_scores")
def text_classifier_scores(spark, sf_dir):
    return _classifier(spark, sf_dir).scores


@query("text_classifier_terms")
def text_classifier_terms(spark, sf_dir):
    return X.top_class_terms(_classifier(spark, sf_dir).model, spark)


@query("feature_build")
def feature_build(spark, sf_dir):
    out = build_features(segments(spark, sf_dir), "o_orderstatus", ["o_orderkey"], polynomial=True, pca=True, tfidf=True)
    return out.test.select("o_orderkey", "o_orderstatus", "PCA1", "PCA2", F.col("c_mktsegment_tfidf").cast("string").alias("segment"))


_TARGETS = {"embeddings": "label", "documents": "n_chars", "labels": "toxic", "part": "p_retailprice", "customer": "c_mktsegment", "events": "props", "supplier": "s_acctbal", "orders": "o_orderpriority"}
_TEXTS = {"customer", "events", "orders"}


@query("target_detection", union_sql([
    f"""SELECT '{t}' AS "table", '{c}' AS target, {'count(*) >= 0' if t in _TEXTS else f'count(DISTINCT {c}) <= greatest(20, floor(0.05 * count(*)))'} AS classification FROM {t}"""
    for t, c in _TARGETS.items()]))
def target_detection(spark, sf_dir):
    """What would be told in each table: a column with a usual name, else the last, and whether as classes."""
    rows = [(t, *autodetect_target(table(spark, sf_dir, t))) for t in _TARGETS]
    return spark.createDataFrame(rows, "table string, target string, classification boolean")

"""Evaluation queries over prediction tables derived from orders, lineitem and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from .registry import query, rounded, table, union_sql

SCORED = """(SELECT (l_returnflag = 'R')::INTEGER AS y_true, (l_discount > 0.05)::INTEGER AS y_pred,
  l_discount * 5 + l_tax AS p FROM lineitem)"""
PRICED = "(SELECT (o_orderstatus = 'F')::INTEGER AS y_true, o_totalprice / 1000000.0::DOUBLE AS p FROM orders)"
CLASSED = """(SELECT o_orderstatus AS y_true, CASE o_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE o_orderstatus END AS y_pred,
  (o_custkey % 10 + 1)::DOUBLE / (o_custkey % 10 + o_orderkey % 7 + 4) AS pf,
  (o_orderkey % 7 + 1)::DOUBLE / (o_custkey % 10 + o_orderkey % 7 + 4) AS po,
  2::DOUBLE / (o_custkey % 10 + o_orderkey % 7 + 4) AS pp FROM orders)"""
CLASSES = ["F", "O", "P"]


def scored(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_discount") > 0.05).cast("int").alias("y_pred"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("p"),
    )


def priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"), (F.col("o_totalprice") / 1000000.0).alias("p")
    )


def classed(spark, sf_dir):
    c, o = F.col("o_custkey") % 10, F.col("o_orderkey") % 7
    total = (c + o + 4).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("y_true"),
        F.when(F.col("o_custkey") % 4 == 0, "F").when(F.col("o_custkey") % 4 == 1, "O").otherwise(F.col("o_orderstatus")).alias("y_pred"),
        F.array((c + 1).cast("double") / total, (o + 1).cast("double") / total, F.lit(2.0) / total).alias("p"),
    )


@query("confusion_matrix", f"""
WITH c AS (SELECT y_true, y_pred, count(*) AS n FROM {CLASSED} GROUP BY ALL),
l AS (SELECT y_true AS v FROM c UNION SELECT y_pred FROM c)
SELECT a.v AS y_true, b.v AS y_pred, coalesce(n, 0)::BIGINT AS n
FROM l a JOIN l b ON true LEFT JOIN c ON c.y_true = a.v AND c.y_pred = b.v""")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(classed(spark, sf_dir), "y_true", "y_pred")


_PER_CLASS = f"""
c AS (SELECT y_true, y_pred, count(*) AS n FROM {{source}} GROUP BY ALL),
l AS (SELECT y_true AS v FROM c UNION SELECT y_pred FROM c),
k AS (SELECT v AS label, coalesce((SELECT sum(n) FROM c WHERE y_true = v AND y_pred = v), 0)::DOUBLE AS tp,
  coalesce((SELECT sum(n) FROM c WHERE y_true = v), 0)::BIGINT AS support,
  coalesce((SELECT sum(n) FROM c WHERE y_pred = v), 0)::BIGINT AS predicted FROM l),
s AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM k)"""


@query("class_report", f"""WITH {_PER_CLASS.format(source=CLASSED)}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM s""")
def class_report(spark, sf_dir):
    return rounded(E.classification_report(classed(spark, sf_dir), "y_true", "y_pred"))


_MCC = """round(coalesce((sum(tp) * sum(support) - sum(predicted::DOUBLE * support))
  / nullif(sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted))
    * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support))), 0), 0), 6) AS mcc"""


def _scores_sql(source: str, average: str) -> str:
    if average == "macro":
        cols = [f"round(avg({m}), 6) AS {m}_macro" for m in ("precision", "recall", "f1")]
    elif average == "micro":
        cols = ["round(sum(tp) / sum(predicted), 6) AS precision_micro", "round(sum(tp) / sum(support), 6) AS recall_micro",
                "round(2 * sum(tp) / (sum(support) + sum(predicted)), 6) AS f1_micro"]
    else:
        cols = [f"round(sum({m} * support) / sum(support), 6) AS {m}_weighted" for m in ("precision", "recall", "f1")]
    return f"""WITH {_PER_CLASS.format(source=source)}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, {', '.join(cols)}, {_MCC} FROM s"""


@query("classification_scores", _scores_sql(CLASSED, "weighted"))
def classification_scores(spark, sf_dir):
    return rounded(E.classification_scores(classed(spark, sf_dir), "y_true", "y_pred"))


@query("classification_scores_macro", _scores_sql(CLASSED, "macro"))
def classification_scores_macro(spark, sf_dir):
    return rounded(E.classification_scores(classed(spark, sf_dir), "y_true", "y_pred", average="macro"))


@query("classification_scores_micro", _scores_sql("(SELECT quality AS y_true, toxic AS y_pred FROM labels)", "micro"))
def classification_scores_micro(spark, sf_dir):
    return rounded(E.classification_scores(table(spark, sf_dir, "labels"), "quality", "toxic", average="micro"))


@query("specificity", f"""
SELECT round(count(*) FILTER (y_true <> 1 AND y_pred <> 1)::DOUBLE / count(*) FILTER (y_true <> 1), 6) AS specificity FROM {SCORED}""")
def specificity(spark, sf_dir):
    return rounded(E.specificity(scored(spark, sf_dir), "y_true", "y_pred", 1))


@query("log_loss", f"""
SELECT round(avg(-ln(least(greatest(CASE WHEN y_true = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16::DOUBLE),
  1 - 2.220446049250313e-16::DOUBLE))), 6) AS log_loss FROM {SCORED}""")
def log_loss(spark, sf_dir):
    return rounded(E.log_loss(scored(spark, sf_dir), "y_true", "p"))


@query("log_loss_multiclass", f"""
SELECT round(avg(-ln(CASE y_true WHEN 'F' THEN pf WHEN 'O' THEN po ELSE pp END)), 6) AS log_loss FROM {CLASSED}""")
def log_loss_multiclass(spark, sf_dir):
    return rounded(E.log_loss(classed(spark, sf_dir), "y_true", "p", CLASSES))


def _ranked(source: str) -> str:
    return f"""g AS (SELECT label, p, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM ({source}) GROUP BY label, p),
r AS (SELECT label, p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER (PARTITION BY label) AS ap, sum(neg) OVER (PARTITION BY label) AS an FROM g
  WINDOW w AS (PARTITION BY label ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""


def _curve_sql(source: str) -> str:
    return f"""WITH {_ranked(source)}
SELECT label, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(ap)::DOUBLE * max(an)), 6) AS auc,
  round(sum(pos * tp::DOUBLE / (tp + fp)) / max(ap), 6) AS ap FROM r GROUP BY label"""


_BINARY = f"SELECT '1' AS label, p, y_true = 1 AS hit FROM {SCORED}"
_BINARY_PRICED = f"SELECT '1' AS label, p, y_true = 1 AS hit FROM {PRICED}"
_RESTS = " UNION ALL ".join(
    f"SELECT '{v}' AS label, {p} AS p, y_true = '{v}' AS hit FROM {CLASSED}" for v, p in zip(CLASSES, ["pf", "po", "pp"]))


@query("roc_auc_average_precision", _curve_sql(_BINARY))
def roc_auc_average_precision(spark, sf_dir):
    return rounded(E.curve_scores(scored(spark, sf_dir), "y_true", "p"))


@query("roc_auc_two_level", _curve_sql(_BINARY_PRICED))
def roc_auc_two_level(spark, sf_dir):
    """The plan for many distinct scores: value ranges, sums per range, windows inside."""
    return rounded(E.curve_scores(priced(spark, sf_dir), "y_true", "p", small=False, bucket_rows=1000))


@query("roc_auc_one_vs_rest", _curve_sql(_RESTS))
def roc_auc_one_vs_rest(spark, sf_dir):
    return rounded(E.curve_scores(classed(spark, sf_dir), "y_true", "p", CLASSES))


@query("macro_auc", f"SELECT round(avg(auc), 6) AS macro_auc, round(avg(ap), 6) AS macro_ap FROM ({_curve_sql(_RESTS).replace(', 6)', ', 15)')})")
def macro_auc(spark, sf_dir):
    return rounded(E.macro_curve_scores(classed(spark, sf_dir), "y_true", "p", CLASSES))


@query("roc_curve", f"""WITH {_ranked(_BINARY)},
n AS (SELECT *, lead(pos) OVER (ORDER BY p DESC) AS npos, lead(neg) OVER (ORDER BY p DESC) AS nneg,
  row_number() OVER (ORDER BY p DESC) AS i FROM r)
SELECT label, round(p, 6) AS threshold, round(fp::DOUBLE / an, 6) AS fpr, round(tp::DOUBLE / ap, 6) AS tpr FROM n
WHERE i = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
UNION ALL SELECT '1', 'infinity'::DOUBLE, 0, 0""")
def roc_curve(spark, sf_dir):
    return rounded(E.roc_curve(scored(spark, sf_dir), "y_true", "p"))


@query("pr_curve", f"""WITH {_ranked(_BINARY)}
SELECT label, round(p, 6) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / ap, 6) AS recall FROM r
UNION ALL SELECT '1', NULL, 1, 0""")
def pr_curve(spark, sf_dir):
    return rounded(E.pr_curve(scored(spark, sf_dir), "y_true", "p"))


@query("threshold_sweep", f"""
WITH t AS (SELECT i * 0.01::DOUBLE AS threshold FROM range(0, 101) r(i)),
s AS (SELECT threshold, count(*) FILTER (p >= threshold AND y_true = 1) AS tp, count(*) FILTER (p >= threshold AND y_true <> 1) AS fp,
  count(*) FILTER (y_true = 1) AS ap FROM t, {SCORED} GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp::DOUBLE / nullif(ap, 0), 0), 6) AS recall,
  round(coalesce(2.0::DOUBLE * tp / nullif(ap + tp + fp, 0), 0), 6) AS f1 FROM s""")
def threshold_sweep(spark, sf_dir):
    return rounded(E.threshold_sweep(scored(spark, sf_dir), "y_true", "p"))


PRICES = """(SELECT CASE WHEN l_linenumber = 4 THEN 0 ELSE l_extendedprice END AS y, l_quantity * 1500 AS p FROM lineitem)"""


def prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 4, 0.0).otherwise(F.col("l_extendedprice")).alias("y"),
        (F.col("l_quantity") * 1500).alias("p"),
    )


_REGRESSION = f"""SELECT round(avg(abs(p - y)), 4) AS mae, round(avg((p - y) * (p - y)), 2) AS mse,
  round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2,
  round(avg(abs(p - y) / nullif(abs(y), 0)) * 100, 6) AS mape,
  round(avg(2 * abs(p - y) / nullif(abs(y) + abs(p), 0)) * 100, 6) AS smape FROM {PRICES}"""


@query("regression_errors", _REGRESSION)
def regression_errors(spark, sf_dir):
    out = E.regression_scores(prices(spark, sf_dir), "y", "p")
    return out.select(F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"),
                      *[F.round(c, 6).alias(c) for c in ("r2", "mape", "smape")])


@query("evaluate_supervised", f"""
WITH c AS ({_scores_sql(CLASSED, 'weighted')}),
m AS (SELECT round(avg(auc), 6) AS macro_auc, round(avg(ap), 6) AS macro_ap FROM ({_curve_sql(_RESTS).replace(', 6)', ', 15)')})),
o AS (SELECT round(avg(-ln(CASE y_true WHEN 'F' THEN pf WHEN 'O' THEN po ELSE pp END)), 6) AS log_loss FROM {CLASSED})
""" + union_sql([f"SELECT '{m}' AS metric, {m}::DOUBLE AS value FROM {t}" for m, t in [
    ("accuracy", "c"), ("precision_weighted", "c"), ("recall_weighted", "c"), ("f1_weighted", "c"), ("mcc", "c"),
    ("macro_auc", "m"), ("macro_ap", "m"), ("log_loss", "o")]]))
def evaluate_supervised(spark, sf_dir):
    return rounded(E.evaluate_supervised(classed(spark, sf_dir), "y_true", "y_pred", proba="p"))


@query("prediction_pairs", f"SELECT y AS y_true, p AS y_pred FROM {PRICES}")
def prediction_pairs(spark, sf_dir):
    return E.prediction_pairs(prices(spark, sf_dir), "y", "p")

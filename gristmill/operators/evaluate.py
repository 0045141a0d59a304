"""Model evaluation as group-bys and running totals over a predictions table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import bounded_values, broadcast_if_small, clean_nan, col, json_safe, materialize, ratio_or_zero, type_class
from ..functions.ordering import bucket_of
from .profile import distinct_more_than
from .running import running_totals

EPS = float(np.finfo(np.float64).eps)
MAX_CLASSES = 10_000


def predictions(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(y_true, y_pred) of one type, rows with a missing side left out."""
    dtype = df.schema[y_true].dataType
    return clean_nan(df).select(col(y_true).alias("y_true"), col(y_pred).cast(dtype).alias("y_pred")).where(
        F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    )


def infer_task(df: DataFrame, y_true: str) -> str:
    """Evaluation rule: numbers with more than 15 distinct values are a regression."""
    numeric = type_class(df.schema[y_true].dataType) in ("int", "float")
    return "regression" if numeric and distinct_more_than(clean_nan(df), y_true, 15) else "classification"


# --- classes -----------------------------------------------------------------


def confusion_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(y_true, y_pred, n): the filled cells of the confusion matrix; one shuffle."""
    return predictions(df, y_true, y_pred).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_table(counts: DataFrame) -> DataFrame:
    """(label, tp, support, predicted) per label seen on either side."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return counts.select(F.inline(sides)).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )


def class_scores(classes: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per label; 0 where undefined."""
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return classes.select(
        "label", ratio_or_zero(tp, predicted).alias("precision"), ratio_or_zero(tp, support).alias("recall"),
        ratio_or_zero(2 * tp, support + predicted).alias("f1"), "support", "tp", "predicted",
    )


def confusion_matrix(
    df: DataFrame, y_true: str, y_pred: str, labels: Sequence | None = None, *, true_labels_only: bool = False
) -> DataFrame:
    """(y_true, y_pred, n) with every cell of the label square, zeros included."""
    counts = confusion_counts(df, y_true, y_pred)
    if labels is None:
        seen = class_table(counts)
        if true_labels_only:
            seen = seen.where(F.col("support") > 0)
        labels = [r[0] for r in bounded_values(seen.select("label").orderBy("label"), "labels; use confusion_counts", MAX_CLASSES)]
    dtype = counts.schema["y_true"].dataType
    listed = df.sparkSession.createDataFrame([(v,) for v in labels], T.StructType([T.StructField("y_true", dtype)]))
    cells = listed.select("y_true", F.explode(F.array(*[F.lit(v).cast(dtype) for v in labels])).alias("y_pred"))
    return cells.join(broadcast_if_small(counts), ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def classification_scores(
    df: DataFrame, y_true: str, y_pred: str, *, average: str = "weighted", pos_label=None
) -> DataFrame:
    """One row: accuracy, precision, recall, f1 (averaged), mcc, and specificity of a positive label."""
    if average not in ("micro", "macro", "weighted"):
        raise ValueError(f"unknown average: {average}")
    counts = confusion_counts(df, y_true, y_pred)
    scores = class_scores(class_table(counts))
    total, hits = F.sum("support").cast("double"), F.sum("tp").cast("double")

    def averaged(name: str) -> Column:
        if average == "micro":
            whole = F.sum("predicted") if name == "precision" else F.sum("support")
            whole = F.sum("support") + F.sum("predicted") if name == "f1" else whole
            return ratio_or_zero((2 if name == "f1" else 1) * F.sum("tp"), whole)
        if average == "macro":
            return F.coalesce(F.avg(name), F.lit(0.0))
        return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("support")), total), F.lit(0.0))

    p, t = F.col("predicted").cast("double"), F.col("support").cast("double")
    cross, pp, tt = F.sum(p * t), F.sum(p * p), F.sum(t * t)
    mcc = F.coalesce(
        F.try_divide(hits * total - cross, F.sqrt((total * total - pp) * (total * total - tt))), F.lit(0.0)
    )
    out = scores.agg(
        ratio_or_zero(F.sum("tp"), F.sum("support")).alias("accuracy"),
        averaged("precision").alias(f"precision_{average}"),
        averaged("recall").alias(f"recall_{average}"),
        averaged("f1").alias(f"f1_{average}"),
        mcc.alias("mcc"),
    )
    if pos_label is not None:
        out = out.withColumn("specificity", F.lit(specificity(df, y_true, y_pred, pos_label).first()[0]).cast("double"))
    return out


def specificity(df: DataFrame, y_true: str, y_pred: str, pos_label) -> DataFrame:
    """(specificity): share of true negatives among all that are not the positive label."""
    negative = F.col("y_true") != F.lit(pos_label)
    return predictions(df, y_true, y_pred).agg(
        F.try_divide(
            F.count_if(negative & (F.col("y_pred") != F.lit(pos_label))).cast("double"), F.count_if(negative).cast("double")
        ).alias("specificity")
    )


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(label, precision, recall, f1, support): per class, then accuracy, macro and weighted rows."""
    scores = class_scores(class_table(confusion_counts(df, y_true, y_pred)))
    each = scores.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    hit = ratio_or_zero(F.sum("tp"), n)

    def weighted(name):
        return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("support")), n.cast("double")), F.lit(0.0))

    row = scores.agg(
        hit.alias("acc"), n.alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    none = F.lit(None).cast("double")

    def line(label, precision, recall, f1):
        return F.struct(F.lit(label).alias("label"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), F.col("n").alias("support"))

    summary = row.select(F.inline(F.array(
        line("accuracy", none, none, F.col("acc")),
        line("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
        line("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
    )))
    return each.unionByName(summary)


# --- probabilities -----------------------------------------------------------


def class_labels(df: DataFrame, y_true: str, y_pred: str | None = None) -> list:
    """Sorted labels seen in the truth (and the predictions)."""
    seen = df.select(col(y_true).alias("l"))
    if y_pred is not None:
        seen = seen.union(df.select(col(y_pred).cast(df.schema[y_true].dataType)))
    return [r["l"] for r in bounded_values(seen.where(F.col("l").isNotNull()).distinct().orderBy("l"), "classes", MAX_CLASSES)]


def probabilities(df: DataFrame, proba: str) -> Column:
    """The probability column; vectors of a fitted model become arrays."""
    return vector_to_array(col(proba)) if isinstance(df.schema[proba].dataType, VectorUDT) else col(proba)


def positive_probability(df: DataFrame, proba: str, labels: Sequence, pos_label=None) -> Column:
    """Probability of the positive class: `pos_label`, else the second label."""
    if isinstance(df.schema[proba].dataType, (T.ArrayType, VectorUDT)):
        pos = labels[1] if pos_label is None else pos_label
        return F.get(probabilities(df, proba), F.lit(list(labels).index(pos))).cast("double")
    return col(proba).cast("double")


def log_loss(df: DataFrame, y_true: str, proba: str, labels: Sequence | None = None, pos_label=None) -> DataFrame:
    """(log_loss) of the true class; probabilities are kept off 0 and 1."""
    labels = class_labels(df, y_true) if labels is None else list(labels)
    if len(labels) == 2:
        pos = labels[1] if pos_label is None else pos_label
        p = positive_probability(df, proba, labels, pos)
        p_true = F.when(col(y_true) == F.lit(pos), p).otherwise(1.0 - p)
    else:
        index = F.array_position(F.array(*map(F.lit, labels)), col(y_true)) - 1
        each = probabilities(df, proba)
        p_true = F.when(F.size(each) == len(labels), F.get(each, index.cast("int"))).cast("double")
    # greatest and least pass over NULLs, which must stay NULL here
    p_true = F.when(p_true.isNotNull(), F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1.0 - EPS)))
    return df.where(col(y_true).isNotNull()).agg(json_safe(F.avg(-F.ln(p_true))).alias("log_loss"))


def score_table(
    df: DataFrame, y_true: str, proba: str, labels: Sequence | None = None, pos_label=None
) -> DataFrame:
    """(label, score, pos, neg): rows per distinct score, for the positive class or each class."""
    labels = class_labels(df, y_true) if labels is None else list(labels)
    if len(labels) == 2 or pos_label is not None:
        pos = labels[1] if pos_label is None else pos_label
        long = df.select(
            F.lit(str(pos)).alias("label"), positive_probability(df, proba, labels, pos).alias("score"),
            (col(y_true) == F.lit(pos)).alias("hit"),
        )
    else:
        each = probabilities(df, proba)
        entries = F.array(*[
            F.struct(F.lit(str(v)).alias("label"), F.get(each, F.lit(i)).cast("double").alias("score"),
                     (col(y_true) == F.lit(v)).alias("hit"))
            for i, v in enumerate(labels)
        ])
        long = df.where(F.size(each) == len(labels)).select(F.inline(entries))
    return (
        long.where(F.col("score").isNotNull() & F.col("hit").isNotNull())
        .groupBy("label", (F.col("score") + 0.0).alias("score"))
        .agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )


def settled(scores: DataFrame, options: dict) -> DataFrame:
    """A score table that several steps read: written once."""
    options.pop("small", None)  # callers may still pass it; there is one plan for all sizes
    return materialize(scores, "scores")


def ranked_scores(scores: DataFrame, *, bucket_rows: int | None = None) -> DataFrame:
    """score_table with running tp, fp (score and above) and the class totals."""
    options = {} if bucket_rows is None else {"bucket_rows": bucket_rows}
    run = running_totals(scores, "score", ["pos", "neg"], groups=["label"], descending=True, **options)
    totals = scores.groupBy("label").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # one row per class
    return run.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp"}).join(F.broadcast(totals), "label")


def curve_scores(df: DataFrame, y_true: str, proba: str, labels=None, pos_label=None, **options) -> DataFrame:
    """(label, auc, ap) for the positive class, or for each class against the rest."""
    scores = settled(score_table(df, y_true, proba, labels, pos_label), options)
    ranked = ranked_scores(scores, **options)
    d = lambda c: F.col(c).cast("double")
    area = F.sum(d("neg") * (d("tp") - d("pos") / 2.0))
    return ranked.groupBy("label").agg(
        F.try_divide(area, F.any_value("all_pos").cast("double") * F.any_value("all_neg").cast("double")).alias("auc"),
        F.try_divide(F.sum(d("pos") * d("tp") / (d("tp") + d("fp"))), F.any_value("all_pos").cast("double")).alias("ap"),
    )


def macro_curve_scores(df: DataFrame, y_true: str, proba: str, labels=None, **options) -> DataFrame:
    """(macro_auc, macro_ap) over the classes."""
    return curve_scores(df, y_true, proba, labels, **options).agg(
        F.avg("auc").alias("macro_auc"), F.avg("ap").alias("macro_ap")
    )


def roc_curve(
    df: DataFrame, y_true: str, proba: str, labels=None, pos_label=None, *, drop_intermediate: bool = True, **options
) -> DataFrame:
    """(label, threshold, fpr, tpr); the start point has an infinite threshold.

    Points on a straight line between their neighbours are dropped by default.
    """
    scores = settled(score_table(df, y_true, proba, labels, pos_label), options)
    ranked = ranked_scores(scores, **options)
    if drop_intermediate:
        ranked = _corner_points(ranked)
    points = ranked.select(
        "label", F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("all_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")).alias("tpr"),
    )
    start = scores.select("label").distinct().select(
        "label", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def _corner_points(ranked: DataFrame) -> DataFrame:
    """First and last point, and points where the next step differs from this one.

    Whether the next score adds the same pos and neg can be read without a
    global window: a step of equal size means tp and fp reappear one step on,
    so each point looks for its successor by its running totals.
    """
    step = ranked.select(
        "label", (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp"),
        F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"),
    )
    joined = ranked.join(step, ["label", "tp", "fp"], "left")
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next_pos").isNull()
    turn = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return joined.where(first | last | turn).drop("next_pos", "next_neg")


def pr_curve(df: DataFrame, y_true: str, proba: str, labels=None, pos_label=None, **options) -> DataFrame:
    """(label, threshold, precision, recall); the end point (1, 0) has no threshold."""
    scores = settled(score_table(df, y_true, proba, labels, pos_label), options)
    points = ranked_scores(scores, **options).select(
        "label", F.col("score").alias("threshold"),
        ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")), F.lit(1.0)).alias("recall"),
    )
    end = scores.select("label").distinct().select(
        "label", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def threshold_sweep(
    df: DataFrame, y_true: str, proba: str, thresholds: Sequence[float] | None = None, pos_label=1
) -> DataFrame:
    """(threshold, precision, recall, f1) when predicting positive at score >= threshold."""
    cuts = sorted(float(t) for t in (np.linspace(0.0, 1.0, 101) if thresholds is None else thresholds))
    listed = F.array(*map(F.lit, cuts))
    hits = (
        df.where(col(y_true).isNotNull())
        .select(bucket_of(col(proba), cuts, inclusive=True).alias("passed"), (col(y_true) == F.lit(pos_label)).alias("hit"))
        .groupBy("passed")
        .agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )
    # at most len(cuts) + 1 rows are left: gather them next to the list of thresholds
    table = hits.agg(F.collect_list(F.struct("passed", "pos", "neg")).alias("h"), F.sum("pos").alias("all_pos"))
    at = table.select(F.posexplode(listed).alias("i", "threshold"), "h", "all_pos")

    def above(field: str) -> Column:
        return F.aggregate("h", F.lit(0).cast("long"), lambda acc, r: acc + F.when(r["passed"] > F.col("i"), r[field]).otherwise(F.lit(0)))

    sums = at.select("threshold", above("pos").alias("tp"), above("neg").alias("fp"), F.coalesce("all_pos", F.lit(0)).alias("all_pos"))
    return sums.select(
        "threshold", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio_or_zero(F.col("tp"), F.col("all_pos")).alias("recall"),
        ratio_or_zero(2 * F.col("tp"), F.col("all_pos") + F.col("tp") + F.col("fp")).alias("f1"),
    )


# --- numbers -----------------------------------------------------------------


def regression_scores(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row: mae, mse, rmse, r2, mape, smape; zero truths do not count in mape."""
    y, p = F.col("y"), F.col("p")
    pairs = clean_nan(df.select(col(y_true).cast("double").alias("y"), col(y_pred).cast("double").alias("p")))
    pairs = pairs.where(y.isNotNull() & p.isNotNull())
    error = p - y
    out = pairs.agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("_var"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.try_divide(F.abs(error), F.abs(y)) * 100.0).alias("mape"),
        (F.avg(F.try_divide(2.0 * F.abs(error), F.abs(y) + F.abs(p))) * 100.0).alias("smape"),
    )
    flat = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("_n") < 2, F.lit(None)).when(F.col("_var") == 0, flat).otherwise(
        1.0 - F.try_divide(F.col("mse"), F.col("_var"))
    )
    return out.select("mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mape", "smape")


def evaluate_supervised(
    df: DataFrame, y_true: str, y_pred: str, *, proba: str | None = None, labels: Sequence | None = None, pos_label=None,
    task: str | None = None,
) -> DataFrame:
    """Tidy (metric, value): the scores that fit the task, told by the truth unless given."""
    if (task or infer_task(df, y_true)) == "regression":
        frames = [regression_scores(df, y_true, y_pred)]
    else:
        frames = [classification_scores(df, y_true, y_pred, pos_label=pos_label)]
        if proba is not None:
            labels = class_labels(df, y_true, y_pred) if labels is None else list(labels)
            if len(labels) == 2:
                frames.append(curve_scores(df, y_true, proba, labels, pos_label).select("auc", "ap"))
            else:
                frames.append(macro_curve_scores(df, y_true, proba, labels))
            frames.append(log_loss(df, y_true, proba, labels, pos_label))
    out = None
    for frame in frames:
        rows = frame.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), col(c).cast("double").alias("value")) for c in frame.columns
        ])))
        out = rows if out is None else out.unionByName(rows)
    return out


def prediction_pairs(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(y_true, y_pred) pairs for a scatter plot."""
    return predictions(df, y_true, y_pred)

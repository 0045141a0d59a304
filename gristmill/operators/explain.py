"""What a fitted model relies on."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, IndexToString
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import clean_nan, col, ratio_or_zero
from ..functions.ordering import shuffle_key
from .frequency import top_per_group

ROWS_PER_BUCKET = 100_000


def shuffled_column(df: DataFrame, column: str, keys: Sequence[str], *, seed: int = 0, rows: int | None = None) -> DataFrame:
    """The table with one column's values moved to other rows.

    Rows are dealt into random buckets of bounded size by key hash; inside each,
    every row takes the value of the next one in hash order. The keys must
    identify rows: copies of one key would share a bucket.
    """
    rows = df.count() if rows is None else rows
    digits = max(0, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET, 16)))
    hashed = df.withColumn("_h", shuffle_key([*keys], seed))
    w = Window.partitionBy(F.substring("_h", 1, digits)).orderBy("_h", *[col(k) for k in keys])
    taken = F.coalesce(F.struct(F.lead(col(column)).over(w).alias("v"), F.lead(F.lit(1)).over(w).alias("more")))
    first = F.first(col(column)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        hashed.withColumn("_taken", taken).withColumn("_first", first)
        .withColumn(column, F.when(F.col("_taken.more").isNull(), F.col("_first")).otherwise(F.col("_taken.v")))
        .select(*[col(c) for c in df.columns])
    )


def shuffled_copies(df: DataFrame, features: Sequence[str], keys: Sequence[str], *, seed: int = 42) -> DataFrame:
    """The table once as it is and once per feature with that column shuffled, told apart by `_copy` (NULL: as it is)."""
    rows = df.count()
    wide = df
    for i, f in enumerate(features):  # the shuffled value beside the own one
        wide = shuffled_column(wide.withColumn(f"_s{i}", col(f)), f"_s{i}", keys, seed=seed + i, rows=rows)

    def copy(k: int | None) -> Column:
        return F.struct(F.lit(k).cast("int").alias("_copy"), *[(F.col(f"_s{i}") if i == k else col(f)).alias(f) for i, f in enumerate(features)])

    kept = [col(c) for c in df.columns if c not in features]
    return wide.select(*kept, F.explode(F.array(copy(None), *[copy(i) for i in range(len(features))])).alias("_row")).select(*kept, "_row.*")


def permutation_importance(
    model: PipelineModel, df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], *,
    task: str = "classification", seed: int = 42,
) -> DataFrame:
    """(feature, score, drop): how much the score falls when one column is shuffled.

    All copies of the table are scored by the model in one pass, and their scores are one grouping.
    """
    scored = model.transform(shuffled_copies(df, features, keys, seed=seed))
    if task == "classification":
        pairs = clean_nan(scored).select(F.col("_copy").alias("_of"), col(target).cast("string").alias("y_true"), F.col("predicted").cast("string").alias("y_pred"))
        score = ratio_or_zero(F.count_if(F.col("y_true") == F.col("y_pred")), F.count(F.lit(1)))
    else:
        pairs = clean_nan(scored.select(F.col("_copy").alias("_of"), col(target).cast("double").alias("y_true"), F.col("prediction").alias("y_pred")))
        error = F.col("y_pred") - F.col("y_true")
        score = 1.0 - F.try_divide(F.avg(error * error), F.var_pop("y_true"))
    pairs = pairs.where("y_true is not null and y_pred is not null")
    found = {r["_of"]: r["score"] for r in pairs.groupBy("_of").agg(score.alias("score")).collect()}  # one row a feature
    base = found.get(None)
    rows = [(f, found.get(i), None if base is None or found.get(i) is None else base - found[i]) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, score double, drop double").orderBy(F.col("drop").desc(), "feature")


def model_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model, named by the assembled inputs."""
    fitted = next(s for s in reversed(model.stages) if hasattr(s, "featureImportances"))
    meta = model.transform(df.limit(0)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", f"feature_{a['idx']}") for group in meta.values() for a in group}
    weights = fitted.featureImportances
    return df.sparkSession.createDataFrame(
        [(names.get(i, f"feature_{i}"), float(weights[i])) for i in range(weights.size)], "feature string, importance double"
    ).orderBy(F.col("importance").desc(), "feature")


def top_class_terms(model: PipelineModel, spark, k: int = 20) -> DataFrame:
    """(label, term, weight, rank): terms that speak most for each class of a text classifier."""
    flat = [s for outer in model.stages for s in (outer.stages if isinstance(outer, PipelineModel) else [outer])]
    vocabulary = next(s for s in flat if isinstance(s, CountVectorizerModel)).vocabulary
    labels = next(s for s in flat if isinstance(s, IndexToString)).getLabels()
    fitted = next(s for s in reversed(flat) if hasattr(s, "theta") or hasattr(s, "coefficients"))
    if hasattr(fitted, "theta"):
        matrix = fitted.theta.toArray()
        rows = [(labels[i], t, float(matrix[i, j])) for i in range(len(labels)) for j, t in enumerate(vocabulary)]
    else:
        w = fitted.coefficients.toArray()
        rows = [(label, t, float(sign * w[j])) for label, sign in ((labels[0], -1), (labels[-1], 1)) for j, t in enumerate(vocabulary)]
    # classes x max_features rows: the size of the model itself
    table = spark.createDataFrame(rows, "label string, term string, weight double")
    return top_per_group(table, ["label"], [F.col("weight").desc(), F.col("term")], k)


__all__ = ["model_importance", "permutation_importance", "shuffled_column", "top_class_terms"]

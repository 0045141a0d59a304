"""Value frequencies of many columns from one shuffle, and top-k lists on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import col, fingerprint, type_class


def value_text(df: DataFrame, name: str) -> Column:
    """A column's value as the text used in frequency tables."""
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(dtype)  # -0.0 and 0.0 are one value
    elif isinstance(dtype, T.BinaryType):
        return F.base64(c)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(c.alias(name)))
    elif type_class(dtype) == "bool":
        return F.initcap(c.cast("string"))
    return c.cast("string")


#: Bytes from which a string is counted by its fingerprint, and characters kept beside it.
HEAD = 64


def value_counts(
    df: DataFrame, cols: Sequence[str], *, compact: bool = False
) -> DataFrame:
    """(column, value, n) over all given columns; NULL values are kept as a group.

    One Expand, map-side partial counts, one shuffle. `compact` lets long
    strings travel as fingerprints (for counting distinct values).
    """
    texts = []
    for c in cols:
        text = value_text(df, c)
        if compact and type_class(df.schema[c].dataType) == "object":
            text = fingerprint(text)
        texts.append(text.alias(c))
    long = df.select(*texts).unpivot([], [col(c) for c in cols], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows of each group.

    `row_number() <= k` lets Spark keep only k rows per group before the
    shuffle, so no task ever receives a whole group.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(column, value, n, rank): k most frequent values per column, missing included; ties by text.

    Long strings are counted as fingerprints with their first characters. All rows that
    rank by count and head among the first k, ties with row k included, get their full
    text back before the last order, so the result is that of ranking full texts.
    """
    long = df.select(*[value_text(df, c).alias(c) for c in cols]).unpivot([], [col(c) for c in cols], "column", "text")
    head = F.substring("text", 1, HEAD)
    counted = long.groupBy("column", fingerprint(F.col("text")).alias("key"), head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("head").asc_nulls_last())
    best = counted.withColumn("_place", F.rank().over(first)).where(F.col("_place") <= k).drop("_place")
    cut = F.octet_length("key") >= HEAD
    texts = (
        long.where(F.octet_length("text") >= HEAD).withColumn("key", fingerprint(F.col("text")))
        .join(best.where(cut).select("column", "key"), ["column", "key"], "left_semi")
        .groupBy("column", "key").agg(F.any_value("text").alias("text"))
    )
    named = best.join(texts, ["column", "key"], "left").select("column", F.coalesce("text", "head").alias("value"), "n")
    return top_per_group(named, ["column"], [F.col("n").desc(), F.col("value").asc_nulls_last()], k)


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value): the mode of each column, smallest value on ties.

    Numeric columns are compared as numbers, others as text.
    """
    parts = []
    numeric = [c for c in cols if type_class(df.schema[c].dataType) in ("int", "float")]
    other = [c for c in cols if c not in numeric]
    if numeric:
        long = df.select(*[col(c).cast("double").alias(c) for c in numeric]).unpivot(
            [], [col(c) for c in numeric], "column", "value"
        )
        counted = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = top_per_group(counted, ["column"], [F.col("n").desc(), F.col("value")], 1)
        parts.append(best.select("column", F.col("value").cast("string").alias("value")))
    if other:
        counted = value_counts(df, other).where(F.col("value").isNotNull())
        best = top_per_group(counted, ["column"], [F.col("n").desc(), F.col("value")], 1)
        parts.append(best.select("column", "value"))
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) > 1 else out

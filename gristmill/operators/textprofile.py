"""Text profile: lengths, tokens, labels, duplicates and character make-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import as_key, col, fingerprint, require_columns, rows_of, spread
from ..functions import text as X
from .profile import class_preview, prob_name

LENGTH_PROBS = (0.5, 0.9, 0.99)


def text_column(name: str, null_text: str | None = None) -> Column:
    """The text to analyse; missing text is left out unless `null_text` names a stand-in."""
    value = col(name).cast("string")
    return value if null_text is None else F.coalesce(value, F.lit(null_text))


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """(rows, missing_text, empty_text, whitespace_only); empty counts as whitespace too."""
    require_columns(df, text)
    value = text_column(text)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(value.isNull()).alias("missing_text"),
        F.count_if(value == "").alias("empty_text"),
        F.count_if(X.is_blank(value)).alias("whitespace_only"),
    )


def whole_number_profile(df: DataFrame, measures: dict[str, Column], probs: Sequence[float] = LENGTH_PROBS) -> DataFrame:
    """(column, count, mean, std, min, p.., max) of whole-number measures in one pass.

    The rows are reduced to (measure, value, n) on the map side; everything
    else, exact quantiles included, is computed from that short table.
    """
    long = spread(df).select(*[m.cast("long").alias(name) for name, m in measures.items()]).unpivot(
        [], [col(n) for n in measures], "column", "value"
    )
    freq = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("value").cast("double"), F.col("n").cast("double")
    stats = freq.groupBy("column").agg(
        F.sum("n").alias("count"), F.sum(v * n).alias("s1"), F.sum(v * v * n).alias("s2"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile("value", [float(p) for p in probs], F.col("n")).alias("q"),
    )
    total = F.col("count").cast("double")
    mean = F.col("s1") / total
    return stats.select(
        "column", "count", mean.alias("mean"),
        F.sqrt(F.greatest((F.col("s2") - F.col("s1") * mean) / total, F.lit(0.0))).alias("std"), "min",
        *[F.get("q", F.lit(i)).alias(prob_name(p)) for i, p in enumerate(probs)], "max",
    )


def length_profile(df: DataFrame, text: str, null_text: str | None = None) -> DataFrame:
    """Statistics of characters and words per text, from one scan."""
    require_columns(df, text)
    value = text_column(text, null_text)
    return whole_number_profile(df.select(col(text)), {
        "char_lengths": F.length(value),
        "word_lengths": F.when(value.isNotNull(), F.size(X.tokens(value))),
    })


def token_counts(df: DataFrame, text: str, *, n: int = 1, null_text: str | None = None) -> DataFrame:
    """(token, count) of all words, or of adjacent word pairs with n=2."""
    require_columns(df, text)
    words = X.tokens(text_column(text, null_text))
    texts = spread(df.select(col(text)))
    if n == 1:
        return texts.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    # pairs stay two columns until they are counted
    counted = texts.select(F.inline(X.word_pairs(words))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.concat_ws(" ", "a", "b").alias("token"), "count")


def most_common(counts: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent entries of a (token, count) table."""
    return counts.orderBy(F.col("count").desc(), "token").limit(k)


def top_tokens(df: DataFrame, text: str, *, n: int = 1, k: int = 30, null_text: str | None = None) -> DataFrame:
    return most_common(token_counts(df, text, n=n, null_text=null_text), k)


def vocabulary_size(df: DataFrame, text: str, *, null_text: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(vocab_estimate): number of different words; `counts` passes a token table made before."""
    counts = token_counts(df, text, null_text=null_text) if counts is None else counts
    return counts.agg(F.count(F.lit(1)).alias("vocab_estimate"))


def label_lengths(df: DataFrame, text: str, label: str, null_text: str | None = None) -> DataFrame:
    """(label, mean_chars, mean_words) per label; the missing label is 'NaN'."""
    require_columns(df, text, label)
    value = text_column(text, null_text)
    return (
        spread(df.select(col(text), col(label)))
        .select(as_key(col(label)).alias("label"), F.length(value).alias("c"),
                  F.when(value.isNotNull(), F.size(X.tokens(value))).alias("w"))
        .groupBy("label")
        .agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("mean_chars"), F.coalesce(F.avg("w"), F.lit(0.0)).alias("mean_words"))
    )


def label_preview(df: DataFrame, label: str) -> DataFrame:
    return class_preview(df, label)


def text_repeats(df: DataFrame, text: str, null_text: str | None = None) -> DataFrame:
    """(head, count) of texts that occur more than once; long texts travel as fingerprints."""
    require_columns(df, text)
    value = text_column(text, null_text)
    return (
        df.where(value.isNotNull())
        .select(fingerprint(value).alias("key"), F.substring(value, 1, 120).alias("head"))
        .groupBy("key")
        .agg(F.any_value("head").alias("head"), F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
        .select("head", "count")
    )


def duplicate_texts(df: DataFrame, text: str, null_text: str | None = None, repeats: DataFrame | None = None) -> DataFrame:
    """(duplicate_texts): how many different texts occur more than once."""
    repeats = text_repeats(df, text, null_text) if repeats is None else repeats
    return repeats.agg(F.count(F.lit(1)).alias("duplicate_texts"))


def top_duplicate_texts(
    df: DataFrame, text: str, k: int = 10, null_text: str | None = None, repeats: DataFrame | None = None
) -> DataFrame:
    """(text, count) of the most repeated texts, cut to 120 characters."""
    repeats = text_repeats(df, text, null_text) if repeats is None else repeats
    return (
        repeats.orderBy(F.col("count").desc(), "head").limit(k)
        .select(F.col("head").alias("text"), "count")
    )


def character_makeup(df: DataFrame, text: str, null_text: str | None = None) -> DataFrame:
    """Mean percent of digits, punctuation and capital letters per text; 0 for no texts."""
    require_columns(df, text)
    value = text_column(text, null_text)

    def mean_share(pattern):
        return F.coalesce(F.avg(F.when(value.isNotNull(), X.share_of(value, pattern))), F.lit(0.0))

    return spread(df.select(col(text))).agg(
        mean_share(X.DIGIT).alias("digits_pct_mean"),
        mean_share(X.PUNCTUATION).alias("punct_pct_mean"),
        mean_share(X.UPPER).alias("upper_pct_mean"),
    )


def as_metrics(one_row: DataFrame, section: str, column: str | None = None) -> DataFrame:
    """One-row numeric result as tidy (section, column, metric, value, text) rows."""
    name = F.lit(column).cast("string") if column is None or column not in one_row.columns else col(column)
    return rows_of(one_row, [
        F.struct(F.lit(section).alias("section"), name.alias("column"), F.lit(c).alias("metric"),
                 col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
        for c in one_row.columns if c != column
    ])

"""Whole-dataset reports as tidy (section, column, metric, value, text) tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import clean_nan, col, empty, materialize, numeric_columns, require_columns
from ..operators import media as I
from ..operators import profile as P
from ..operators import textprofile as X
from ..operators.quantiles import exact_quantiles
from ..sources import files as S
from ..sources.tables import read_table, record, suffix

T = TypeVar("T")
SCHEMA = "section string, column string, metric string, value double, text string"


def _tidy(df: DataFrame, section: str, key: Column | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """Melt a result table; `key` names the column or value a row is about."""
    skip = {"column", "key", "metric"}
    rows = [
        F.struct(
            F.lit(section).alias("section"), (F.lit(None).cast("string") if key is None else key).alias("column"),
            F.lit(c).alias("metric"),
            (F.lit(None) if c in texts else col(c)).cast("double").alias("value"),
            (col(c) if c in texts else F.lit(None)).cast("string").alias("text"),
        )
        for c in df.columns if c not in skip
    ]
    return df.select(F.inline(F.array(*rows)))


def _pairs(df: DataFrame, section: str) -> DataFrame:
    """A (metric, key, value) table in report form: the key goes to `text`."""
    return df.select(F.lit(section).alias("section"), F.lit(None).cast("string").alias("column"), "metric", "value", F.col("key").alias("text"))


def _collect(spark: SparkSession, sections: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Union of the sections, each computed and written by a job of its own.

    One that cannot be built, or fails while it runs, leaves a '<section>_error' row; the others stand.
    """
    out = empty(spark, SCHEMA)
    for name, build in sections.items():
        try:
            part = materialize(build(), f"section-{name}")
        except Exception as e:  # noqa: BLE001 - a failing section must not stop the others
            part = spark.createDataFrame([(f"{name}_error", None, "error", None, str(e)[:1000])], SCHEMA)
        out = out.unionByName(part)
    return out


def _once(build: Callable[[], T]) -> Callable[[], T]:
    """What several sections share, made when the first of them asks; if it fails, each of them fails alone."""
    return functools.cache(build)


def table_report(df: DataFrame, target: str | None = None, *, k: int = 30) -> DataFrame:
    """Schema, memory, duplicates, dates, numbers, categories, missing values, target.

    Shape, memory, dates and missing values come from one scan.
    """
    column = F.col("column")
    fitted: dict = {}

    def numbers():
        fitted.update(exact_quantiles(clean_nan(df), numeric_columns(df), P.PROFILE_PROBS))
        return _tidy(P.numeric_profile(df, quantiles=fitted), "numeric_stats", column)

    def outliers():
        at = [P.PROFILE_PROBS.index(p) for p in (0.25, 0.75)]
        quartiles = {c: tuple(q[i] for i in at) for c, q in fitted.items()}
        return _tidy(P.iqr_outliers(df, quartiles=quartiles or None), "outliers", column)

    def correlations():
        pairs = P.correlation_pairs(df)
        return pairs.select(F.lit("pearson_corr_top").alias("section"), F.col("col_a").alias("column"), F.lit("abs_corr").alias("metric"),
                            F.col("abs_corr").alias("value"), F.col("col_b").alias("text"))

    def categories():
        top = P.categorical_profile(df, k=k)
        return top.select(F.lit("categorical_stats").alias("section"), "column", F.lit("top_value").alias("metric"),
                          F.col("n").cast("double").alias("value"), F.col("value").alias("text"))

    sections = {
        "shape": lambda: _tidy(P.table_shape(df), "shape"),
        "schema_summary": lambda: _tidy(P.schema_summary(df).withColumn("high_cardinality", F.col("high_cardinality").cast("int")),
                                        "schema_summary", column, ("dtype",)),
        "memory_summary": lambda: _tidy(P.memory_summary(df), "memory_summary", column),
        "duplicate_summary": lambda: _tidy(P.duplicate_summary(df), "duplicate_summary"),
        "datetime_overview": lambda: _tidy(P.datetime_overview(df), "datetime_overview", column, ("min", "max")),
        "numeric_stats": numbers,
        "outliers": outliers,
        "pearson_corr_top": correlations,
        "categorical_stats": categories,
        "missingness_summary": lambda: _tidy(P.missingness(df), "missingness_summary", column),
        "rows_with_missing": lambda: _tidy(P.rows_with_missing(df), "rows_with_missing"),
        "target_preview": lambda: _pairs(P.target_preview(df, target), "target_preview"),
    }
    with P.one_scan(df):
        return _collect(df.sparkSession, sections)


def text_report(
    df: DataFrame, text: str, target: str | None = None, *, k: int = 30, bigrams: bool = True, null_text: str | None = None
) -> DataFrame:
    """Counts, lengths, tokens, labels, duplicates and character make-up of a text column."""
    require_columns(df, text)
    column = F.col("column")
    # tables that two sections read are written once
    words = _once(lambda: materialize(X.token_counts(df, text, null_text=null_text), "tokens"))
    copies = _once(lambda: materialize(X.text_repeats(df, text, null_text), "repeats"))

    def tokens(counts: DataFrame, name: str):
        return X.most_common(counts, k).select(
            F.lit("token_stats").alias("section"), F.lit(None).cast("string").alias("column"), F.lit(name).alias("metric"),
            F.col("count").cast("double").alias("value"), F.col("token").alias("text"))

    def repeats():
        return X.top_duplicate_texts(df, text, repeats=copies()).select(
            F.lit("duplicates").alias("section"), F.lit(None).cast("string").alias("column"), F.lit("top_duplicate_text").alias("metric"),
            F.col("count").cast("double").alias("value"), "text")

    sections = {
        "counts": lambda: _tidy(X.text_counts(df, text), "counts"),
        "lengths": lambda: _tidy(X.length_profile(df, text, null_text), "lengths", column),
        "vocabulary": lambda: _tidy(X.vocabulary_size(df, text, counts=words()), "token_stats"),
        "top_unigrams": lambda: tokens(words(), "top_unigram"),
    }
    if bigrams:
        sections["top_bigrams"] = lambda: tokens(X.token_counts(df, text, n=2, null_text=null_text), "top_bigram")
    if target and target in df.columns:
        sections["label_preview"] = lambda: _pairs(X.label_preview(df, target), "label_preview")
        sections["per_label_text_len"] = lambda: _tidy(
            X.label_lengths(df, text, target, null_text), "per_label_text_len", F.col("label"), ("label",)
        ).where(F.col("metric") != "label")
    sections["duplicate_rows"] = lambda: _tidy(P.duplicate_summary(df), "duplicates")
    sections["duplicate_texts"] = lambda: _tidy(X.duplicate_texts(df, text, repeats=copies()), "duplicates")
    sections["top_duplicate_texts"] = repeats
    sections["char_composition"] = lambda: _tidy(X.character_makeup(df, text, null_text), "char_composition")
    return _collect(df.sparkSession, sections)


def _labelled(df: DataFrame, section: str, name: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.lit(None).cast("string").alias("column"), F.lit("n").alias("metric"),
                     F.col("n").cast("double").alias("value"), col(name).alias("text"))


def image_report(files: DataFrame, root: str | None = None) -> DataFrame:
    """Report on image files given as (path, class) or (path, class, content); sample paths are relative to root.

    Headers are read once for all sections, by ranged reads where no content is given.
    """
    headers = _once(lambda: materialize(I.image_headers(files), "headers"))
    return _collect(files.sparkSession, {
        "classes": lambda: _tidy(I.class_count(files), "classes"),
        "class_counts_top20": lambda: _labelled(I.class_counts(files), "class_counts_top20", "class"),
        "small_classes_lt10": lambda: _labelled(I.small_classes(files), "small_classes_lt10", "class"),
        "integrity": lambda: _tidy(I.image_integrity(headers()), "integrity"),
        "sizes": lambda: _tidy(I.image_sizes(headers()), "sizes", F.col("column")),
        "mode_counts_top": lambda: _labelled(I.image_modes(headers()), "mode_counts_top", "mode"),
        "sample_paths": lambda: I.sample_paths(files if root is None else files.withColumn("path", S.relative_path(F.col("path"), root))).select(
            F.lit("sample_paths").alias("section"), F.lit(None).cast("string").alias("column"), F.lit("path").alias("metric"),
            F.lit(None).cast("double").alias("value"), F.col("path").alias("text")),
    })


def image_folder_report(spark: SparkSession, root: str) -> DataFrame:
    files = materialize(S.labelled_files(spark, root, S.IMAGE_EXTENSIONS), "files")
    return image_report(files, root)


def image_manifest_report(
    spark: SparkSession, manifest_path: str, image_col: str, label_col: str | None = None, base_dir: str | None = None
) -> DataFrame:
    """Report on the images a table lists, wherever they lie; class counts include rows whose file is missing."""
    manifest = read_table(spark, manifest_path)
    require_columns(manifest, image_col)
    root = base_dir or manifest_path.rsplit("/", 1)[0]
    rows = materialize(S.manifest_files(manifest, image_col, base_dir=root), "manifest")
    headers = _once(lambda: materialize(I.image_headers(rows.where("found").select(F.col("full_path").alias("path"))), "headers"))
    sections = {
        "manifest": lambda: _tidy(I.manifest_counts(rows), "manifest"),
        "integrity": lambda: _tidy(I.image_integrity(headers()), "integrity"),
        "sizes": lambda: _tidy(I.image_sizes(headers()), "sizes", F.col("column")),
        "mode_counts_top": lambda: _labelled(I.image_modes(headers()), "mode_counts_top", "mode"),
    }
    if label_col and label_col in manifest.columns:
        sections["class_counts_top20"] = lambda: _labelled(I.class_counts(rows, label_col), "class_counts_top20", "class")
        sections["small_classes_lt10"] = lambda: _labelled(I.small_classes(rows, label_col), "small_classes_lt10", "class")
    return _collect(spark, sections)


def image_dataset_report(
    spark: SparkSession, source: str, *, image_col: str | None = None, label_col: str | None = None, base_dir: str | None = None
) -> DataFrame:
    """Folder of images, or a CSV / Parquet / Feather table that lists them."""
    kind = suffix(source)
    if kind in (".csv", ".parquet", ".feather"):
        if not image_col:
            raise ValueError("a table of images needs image_col")
        return image_manifest_report(spark, source, image_col, label_col, base_dir)
    if kind:
        raise ValueError(f"unsupported source for image profiling: {source}")
    return image_folder_report(spark, source)


def model_card(train: DataFrame, test: DataFrame, target: str, scores: DataFrame, name: str) -> DataFrame:
    """(card): one JSON row with schema, split sizes and metrics of a model."""
    schema = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in train.schema.fields])
    sizes = [F.lit(train.count()).alias("train_rows"), F.lit(test.count()).alias("test_rows")]
    metrics = F.struct(*[col(c) for c in scores.columns]).alias("metrics")
    return scores.limit(1).select(
        F.to_json(F.struct(F.lit(name).alias("model"), F.lit(target).alias("target"), schema.alias("columns"), *sizes, metrics)).alias("card")
    )


def report_json(report: DataFrame) -> DataFrame:
    """Report rows as JSON lines."""
    return report.select(record(report).alias("value"))

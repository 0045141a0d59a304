"""Reading and writing tables, the format chosen by suffix."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import col, new_path
from ..operators.quality import concat_tables
from . import arrow_ipc, csv_records

# Delimiters tried, and the size of the text sample they are tried on.
DELIMITERS = [",", ";", "\t", "|", ":"]
SAMPLE_BYTES = 64_000


def suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def first_bytes(spark: SparkSession, path: str, sample_bytes: int) -> list[str]:
    """First lines up to sample_bytes in all, and at least one; lines are cut in the plan."""
    lines = spark.read.text(path).select(F.substring("value", 1, sample_bytes).alias("value")).limit(sample_bytes)
    size = F.octet_length("value") + 1
    lines = lines.withColumn("n", F.monotonically_increasing_id())
    total = F.sum(size).over(Window.orderBy("n"))  # over at most sample_bytes short rows
    return [r["value"] for r in lines.withColumn("upto", total).where((F.col("upto") <= sample_bytes) | (F.col("upto") == size)).orderBy("n").collect()]


def sniff_delimiter(spark: SparkSession, path: str, sample_bytes: int = SAMPLE_BYTES) -> str:
    """Delimiter that splits the first lines most evenly, else the most frequent one."""
    lines = first_bytes(spark, path, sample_bytes)
    lines = [line for line in lines if line.strip()]
    counts = {d: [line.count(d) for line in lines] for d in DELIMITERS}

    def evenness(d: str) -> tuple[float, float]:
        filled = [n for n in counts[d] if n]
        if not filled:
            return (0.0, 0.0)
        usual = max(set(filled), key=filled.count)
        return (filled.count(usual) / len(counts[d]), float(usual))

    best = max(DELIMITERS, key=evenness)
    if evenness(best)[0] >= 0.9:
        return best
    return max(DELIMITERS, key=lambda d: sum(counts[d]))


def read_csv(
    spark: SparkSession, path: str, *, sep: str | None = None, schema: T.StructType | None = None, multiline: bool | None = None
) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given.

    Whether quoted values hold line breaks is found by a scan of the lines with quotes. If
    some do, lines are joined to records split by split (see csv_records), so a large file
    is still read by many tasks. multiline says it beforehand: False skips the scan.
    """
    sep = sniff_delimiter(spark, path) if sep is None else sep
    line_sep = line_break(spark, path)
    lines = csv_records.lines_of(spark, path, line_sep)
    if multiline is None:
        multiline = csv_records.spans_lines(lines, sep)
    if multiline:
        records, header = csv_records.csv_records(lines, sep, line_sep)
        return csv_records.parse(records, header, sep, schema)
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def line_break(spark: SparkSession, path: str) -> str:
    """What ends a line: a carriage return only where the file's start has no line feed."""
    start = spark.read.option("lineSep", "\n").text(path).select(F.substring("value", 1, SAMPLE_BYTES).alias("v")).head()
    text = start["v"] if start else ""
    return "\r" if "\r" in text.rstrip("\r") and len(text) == SAMPLE_BYTES else "\n"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One record per line; blank lines and an absent path give no rows."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.json(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([], schema or T.StructType())


def read_json(spark: SparkSession, path: str, default: DataFrame | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Files that hold an array of records each; `default` if the path is absent."""
    reader = spark.read.option("multiLine", True)
    try:
        return (reader if schema is None else reader.schema(schema)).json(path)
    except AnalysisException as e:
        if default is None or not is_missing(e):
            raise
        return default


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    arrow_ipc.register(spark)
    return spark.read.format("feather").load(path)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = suffix(path)
    if kind == ".csv":
        return read_csv(spark, path, **options)
    if kind == ".jsonl":
        return read_jsonl(spark, path, **options)
    if kind == ".json":
        return read_json(spark, path, **options)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".feather":
        return read_feather(spark, path)
    if kind in (".xlsx", ".xls"):
        raise ValueError("convert spreadsheets to CSV or Parquet first")
    raise ValueError(f"unsupported table format: {kind} (path={path})")


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several tables below each other, columns matched by name."""
    return concat_tables([read_table(spark, p) for p in paths])


def record(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def _as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of one JSON array per task, holding back a single record for its comma."""
    yield pd.DataFrame({"value": ["["]})
    held = None
    for pdf in batches:
        lines = pdf["value"].tolist()
        if held is not None:
            lines = [held, *lines]
        if lines:
            held = lines.pop()
        if lines:
            yield pd.DataFrame({"value": [line + "," for line in lines]})
    yield pd.DataFrame({"value": ([held] if held is not None else []) + ["]"]})


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    """Write by suffix; the result is a folder of part files that read_table reads back."""
    kind = suffix(path)
    if kind == ".csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif kind == ".jsonl":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif kind == ".json":
        df.select(record(df).alias("value")).mapInPandas(_as_array, "value string").write.mode(mode).text(path)
    elif kind == ".parquet":
        df.write.mode(mode).parquet(path)
    elif kind == ".feather":
        arrow_ipc.register(df.sparkSession)
        df.write.format("feather").mode(mode).save(path)
    else:
        raise ValueError(f"unsupported save format: {kind} (path={path})")
    return path


def write_report(one_row: DataFrame, path: str) -> str:
    """A report table as JSON lines, written aside and put in place of an earlier one when it is complete."""
    spark = one_row.sparkSession
    made = new_path(spark, "report").rpartition("/")[2]
    aside, old = (f"{path.rstrip('/')}.{made}.{kind}" for kind in ("new", "old"))
    one_row.write.option("ignoreNullFields", False).json(aside)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = system.exists(at(path))
    if had and not system.rename(at(path), at(old)):
        raise OSError(f"cannot move the earlier report at {path}")
    if not system.rename(at(aside), at(path)):
        raise OSError(f"cannot put the report in place at {path}; it is at {aside}")
    if had:
        system.delete(at(old), True)
    return path


def read_text(spark: SparkSession, path: str, default: str | None = None) -> DataFrame:
    """(path, text): one row per whole text file; one row with `default` if the path is absent."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([(path, default)], "path string, text string").where(F.lit(default is not None))


def write_text(df: DataFrame, text: str, path: str, *, mode: str = "overwrite") -> str:
    df.select(col(text).cast("string").alias("value")).write.mode(mode).text(path)
    return path


def csv_stream(
    spark: SparkSession, folder: str, schema: T.StructType, *, sep: str | None = None, files_per_trigger: int = 100, **options: Any
) -> DataFrame:
    """CSV files read chunk by chunk: a stream whose batches hold a bounded number of files.

    The delimiter is found in the files present at the start unless it is given; doubled quotes are read as one.
    """
    sep = sniff_delimiter(spark, folder) if sep is None else sep
    reader = spark.readStream.schema(schema).option("header", True).option("sep", sep).option("escape", '"')
    return reader.option("maxFilesPerTrigger", files_per_trigger).options(**options).csv(folder)

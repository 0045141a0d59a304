"""Profiles and drift scores over files as they arrive (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import clean_nan, col, new_path, percent, rows_of
from ..operators.drift import Baseline, bin_counts, drift_scores


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", *, name_glob: str | None = None,
    files_per_trigger: int | None = None, **options,
) -> DataFrame:
    """Files of a folder as a stream; a batch takes at most files_per_trigger of them."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def start_profile(stream: DataFrame, cols: Sequence[str], table: str, checkpoint: str):
    """Start keeping a running profile: each batch writes one row of totals to `table`/batch=<n>."""
    cleaned = clean_nan(stream)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        v = col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]

    def publish(batch: DataFrame, batch_id: int) -> None:
        # same batch number, same folder: a repeated batch replaces itself
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        cleaned.agg(*aggs).writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_profile(spark: SparkSession, cols: Sequence[str], table: str) -> DataFrame:
    """Latest running profile: (column, count, missing, missing_pct, mean, std, min, max)."""
    states = spark.read.parquet(table)
    last = states.orderBy(F.col("batch").desc()).limit(1)
    missing = lambda i: F.col("_rows") - F.col(f"n{i}")
    return rows_of(last, [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), missing(i).alias("missing"),
                 percent(missing(i), F.col("_rows")).alias("missing_pct"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)
    ])


def profile_stream(stream: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Run over all files present now and return the profile."""
    spark = stream.sparkSession
    table = new_path(spark, "stream-profile")
    start_profile(stream, cols, table, table + "-state").awaitTermination()
    return read_profile(spark, cols, table)


def start_drift(stream: DataFrame, base: Baseline, ts: str, table: str, checkpoint: str, *, width: str = "1 day", lateness: str = "1 hour"):
    """Start writing bin counts of every closed window; rows later than `lateness` are left out."""
    timed = stream.withColumn("_ts", col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    counts = bin_counts(timed, base, [F.window("_ts", width).alias("w")]).select(F.col("w.start").alias("window_start"), "bin", "n")

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("append").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_drift(spark: SparkSession, base: Baseline, table: str) -> DataFrame:
    """(window_start, n, psi, kl) of the windows closed so far."""
    return drift_scores(spark.read.parquet(table).drop("batch"), base, ["window_start"])


def drift_stream(stream: DataFrame, base: Baseline, ts: str, *, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Run over all files present now and return the drift of the closed windows."""
    spark = stream.sparkSession
    table = new_path(spark, "stream-drift")
    start_drift(stream, base, ts, table, table + "-state", width=width, lateness=lateness).awaitTermination()
    return read_drift(spark, base, table)

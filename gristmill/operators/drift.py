"""Distribution drift between a baseline and newer rows: PSI and KL divergence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import as_key, broadcast_if_small, clean_nan, col, materialize, type_class
from ..functions.ordering import bucket_of
from .quantiles import exact_quantiles

FLOOR = 1e-6  # smallest share of a bin


@dataclass(frozen=True)
class Baseline:
    """Frozen reference distribution: bin edges (numbers only) and the share of each bin, a written table."""

    column: str
    edges: tuple[float, ...] | None
    shares: DataFrame  # (bin, e)
    version: str | None = None  # of a published one

    def bin_of(self) -> Column:
        if self.edges is None:
            return as_key(col(self.column))
        return bucket_of(col(self.column), self.edges).cast("string")


def share(n: Column, total: Column) -> Column:
    return F.greatest(n.cast("double") / total.cast("double"), F.lit(FLOOR))


def fit_baseline(df: DataFrame, column: str, bins: int = 10) -> Baseline:
    """Quantile bins of a numeric column, or the categories of any other column.

    The column is read from its source once; edges and shares are of the same rows and
    do not change when the source does.
    """
    df = clean_nan(df.select(col(column)))
    edges = None
    if type_class(df.schema[column].dataType) in ("int", "float"):
        df = materialize(df.where(col(column).isNotNull()).select(col(column).alias("value")), "baseline").select(F.col("value").alias(column))
        inner = exact_quantiles(df, [column], [i / bins for i in range(1, bins)])[column]
        edges = tuple(sorted({e for e in inner if e is not None}))
    counts = materialize(df.groupBy(Baseline(column, edges, df).bin_of().alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bins")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return Baseline(column, edges, materialize(counts.select("bin", share(F.col("n"), F.lit(total)).alias("e")), "shares"))


CURRENT = "CURRENT"


def publish_baseline(base: Baseline, path: str) -> str:
    """Write a baseline as a new version below path, then make it the current one in a single step; its version.

    Whoever reads meanwhile gets the earlier version or this one, edges and shares always of the same.
    """
    spark = base.shares.sparkSession
    version = spark.range(1).select(F.expr("concat(date_format(current_timestamp(), 'yyyyMMddHHmmssSSS'), '-', uuid())")).first()[0]
    folder = f"{path.rstrip('/')}/version={version}"
    base.shares.write.parquet(f"{folder}/shares")
    edges = None if base.edges is None else list(base.edges)
    spark.createDataFrame([(base.column, edges)], "column string, edges array<double>").coalesce(1).write.json(f"{folder}/edges")
    jvm = spark._jvm
    made, current = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}") for name in (f"{CURRENT}-{version}", CURRENT))
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    how = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(system.makeQualified(made), system.makeQualified(current), how)
    return version


def load_baseline(spark: SparkSession, path: str, version: str | None = None) -> Baseline:
    """The current version of a published baseline, or a given one."""
    root = path.rstrip("/")
    if version is None:
        version = spark.read.text(f"{root}/{CURRENT}", wholetext=True).first()[0]
    folder = f"{root}/version={version}"
    row = spark.read.schema("column string, edges array<double>").json(f"{folder}/edges").first()
    shares = spark.read.schema("bin string, e double").parquet(f"{folder}/shares")
    return Baseline(row["column"], None if row["edges"] is None else tuple(row["edges"]), shares, version)


def bin_counts(df: DataFrame, base: Baseline, groups: Sequence[Column] = ()) -> DataFrame:
    """(groups.., bin, n) of newer rows; works on batch and streaming frames."""
    if base.edges is not None:
        df = clean_nan(df).where(col(base.column).isNotNull())
    return df.groupBy(*groups, base.bin_of().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drift_scores(counts: DataFrame, base: Baseline, groups: Sequence[str] = ()) -> DataFrame:
    """(groups.., n, psi, kl) from bin counts.

    A bin a group lacks has the floor share. Its term depends on the baseline
    only, so the sum over all baseline bins is taken once and corrected for the
    bins that are present: absent bins never have to be listed per group.
    """
    e, a = F.col("e"), F.col("a")

    def psi(x, y):
        return (x - y) * F.ln(x / y)

    def kl(x, y):
        return x * F.ln(x / y)

    floor = F.lit(FLOOR)
    absent = base.shares.agg(F.sum(psi(floor, e)).alias("p"), F.sum(kl(floor, e)).alias("k")).first()
    groups = list(groups)
    keyed = counts if groups else counts.withColumn("_all", F.lit(1))
    keys = groups or ["_all"]
    totals = keyed.groupBy(*keys).agg(F.sum("n").alias("total"))
    terms = (
        keyed.join(broadcast_if_small(totals), keys)
        .join(broadcast_if_small(base.shares), "bin", "left")
        .withColumn("a", share(F.col("n"), F.col("total")))
    )
    known = e.isNotNull()
    other = F.coalesce(e, floor)
    out = terms.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.lit(absent["p"] or 0.0) + F.sum(psi(a, other) - F.when(known, psi(floor, e)).otherwise(0.0))).alias("psi"),
        (F.lit(absent["k"] or 0.0) + F.sum(kl(a, other) - F.when(known, kl(floor, e)).otherwise(0.0))).alias("kl"),
    )
    return out if groups else out.drop("_all")


def drift(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(column, n, psi, kl) of one column."""
    base = fit_baseline(baseline, column, bins)
    return drift_scores(bin_counts(current, base), base).select(F.lit(column).alias("column"), "n", "psi", "kl")


def drift_by_window(base: Baseline, current: DataFrame, ts: str, width: str = "1 day") -> DataFrame:
    """(window_start, n, psi, kl) per tumbling window against a frozen baseline."""
    start = F.window(col(ts), width)["start"].alias("window_start")
    return drift_scores(bin_counts(current, base, [start]), base, ["window_start"])


def psi_of_shares(current: Sequence[float], expected: Sequence[float]) -> float:
    """PSI of two short lists of shares (for checks)."""
    pairs = [(max(c, FLOOR), max(x, FLOOR)) for c, x in zip(current, expected)]
    return sum((c - x) * math.log(c / x) for c, x in pairs)

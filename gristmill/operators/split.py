"""Reproducible exact-size samples and train/test splits.

Rows are ordered by the MD5 text of their key. The cut for the wanted number of
rows is found from counts per hash prefix (at most 16^5 per class), then inside
the one prefix the cut falls into. Assigning rows is a comparison with the cut:
no sort and no limit over the data. Rows that share a key stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import as_key, col, require_columns
from ..functions.ordering import shuffle_key

# Hash prefixes are made long enough to leave about this many rows in each.
PREFIX_ROWS = 4096
LONGEST_PREFIX = 5
MAX_STRATA = 100_000


def _cuts(df: DataFrame, keys: Sequence[str], seed: int, want: Column, stratum: Column) -> list[tuple[str, str]]:
    """(stratum, hash): the last hash taken per stratum; `want` is computed from `total`."""
    digits = math.ceil(math.log(max(df.count() / PREFIX_ROWS, 1), 16))
    hashed = df.select(stratum.alias("s"), shuffle_key(keys, seed).alias("h")).withColumn(
        "prefix", F.substring("h", 1, min(max(digits, 1), LONGEST_PREFIX))
    )
    counts = hashed.groupBy("s", "prefix").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(
        "s", "prefix", "n", upto.alias("upto"), F.sum("n").over(Window.partitionBy("s")).alias("total")
    ).withColumn("want", want.cast("long"))
    crossing = placed.where((F.col("upto") - F.col("n") < F.col("want")) & (F.col("want") <= F.col("upto"))).select(
        "s", "prefix", (F.col("want") - F.col("upto") + F.col("n")).alias("need")
    )
    marks = crossing.limit(MAX_STRATA + 1).collect()  # one row per stratum
    if len(marks) > MAX_STRATA:
        raise ValueError("too many strata for a stratified split")
    if not marks:
        return []
    few = df.sparkSession.createDataFrame([tuple(r) for r in marks], crossing.schema)
    inside = hashed.join(F.broadcast(few), ["s", "prefix"]).groupBy("s", "h", "need").agg(F.count(F.lit(1)).alias("n"))
    reach = F.sum("n").over(Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    found = (
        inside.withColumn("upto", reach)
        .where((F.col("upto") - F.col("n") < F.col("need")) & (F.col("need") <= F.col("upto")))
        .select("s", "h")
    )
    return [(r["s"], r["h"]) for r in found.collect()]


def random_split(
    df: DataFrame,
    keys: Sequence[str],
    test_share: float = 0.2,
    *,
    seed: int = 42,
    stratify: str | None = None,
    out: str = "split",
) -> DataFrame:
    """Add a 'train'/'test' column: ceil(n * share) test rows, or round(n_y * share) per class."""
    require_columns(df, *keys, *([stratify] if stratify else []))
    if not 0.0 < test_share < 1.0:
        raise ValueError("test_share must lie between 0 and 1")
    h = shuffle_key(keys, seed)
    total = F.col("total")
    if stratify is None:
        cuts = _cuts(df, keys, seed, F.ceil(total * F.lit(test_share)), F.lit(""))
        cut = F.lit(cuts[0][1] if cuts else "")
        return df.withColumn(out, F.when(h <= cut, "test").otherwise("train"))
    stratum = as_key(col(stratify))
    cuts = _cuts(df, keys, seed, F.round(total * F.lit(test_share)), stratum)
    schema = "_stratum string, _cut string"
    few = df.sparkSession.createDataFrame(cuts, schema)
    return (
        df.withColumn("_stratum", stratum)
        .join(F.broadcast(few), "_stratum", "left")
        .withColumn(out, F.when(h <= F.col("_cut"), "test").otherwise("train"))
        .select(*[col(c) for c in df.columns], out)
    )


def parts(split: DataFrame, name: str = "split") -> tuple[DataFrame, DataFrame]:
    """(train, test) frames of a split table."""
    return split.where(F.col(name) == "train").drop(name), split.where(F.col(name) == "test").drop(name)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], *, seed: int = 42) -> DataFrame:
    """Uniform sample of exactly n rows (all rows if there are fewer)."""
    require_columns(df, *keys)
    cuts = _cuts(df, keys, seed, F.least(F.col("total"), F.lit(n)), F.lit(""))
    return df.where(shuffle_key(keys, seed) <= F.lit(cuts[0][1] if cuts else ""))

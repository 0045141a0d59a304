"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.core import materialize

#: The matrix is broadcast up to this size: one row for each partition. Beyond, it is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Rows that the second permutation sorts in one group.
ROWS_PER_GROUP = 20_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among draws without replacement, by inversion around the mode.

    Covers twelve deviations on both sides, so the left-out mass is below 1e-30;
    there is no limit on the numbers.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    deviation = math.sqrt(max(mean * bad / total * (total - draws) / max(total - 1, 1), 0.0))
    a, b = max(low, int(mean - 12 * deviation) - 8), min(high, int(mean + 12 * deviation) + 8)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    shares = np.cumsum(np.exp(weights - weights.max()))
    return a + int(np.searchsorted(shares, rng.random() * shares[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each partition sends to each shard: an exact draw of what a uniform permutation would give.

    The sizes of the shards differ by one at most, the larger ones first.
    """
    rng = np.random.default_rng(seed)
    total = sum(counts)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, left, open_slots = [], n, sum(free)
        for s in range(shards):
            k = hypergeometric(rng, free[s], open_slots - free[s], left)
            open_slots -= free[s]
            left -= k
            row.append(k)
        free = [f - k for f, k in zip(free, row)]
        matrix.append(row)
    return matrix


def shuffle_to_shards(df: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """df's rows with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    1. Each partition permutes its rows at random (a local sort, no shuffle); the
       outcome is written, so later jobs and repeated tasks see the same order.
    2. From the partitions' row counts the matrix is drawn on the driver: one small
       row for each partition. Partition p's first M[p][0] rows go to shard 0, and so on.
    3. The rows are exchanged into groups of about 20,000 rows, each a random part of
       one shard, and permuted once more there.

    All counts and groups follow row numbers, never values: equal texts, null texts,
    null or repeated ids and empty texts are rows as any other. An empty table gives
    no rows. Input columns named shard or slot are replaced; all others stay.
    """
    spark = df.sparkSession
    rows = df.drop("shard", "slot").select(F.struct("*").alias("row"), F.rand(seed).alias("order")).sortWithinPartitions("order")
    number = F.monotonically_increasing_id()
    placed = materialize(rows.select("row", number.alias("n")), "permuted").select(
        "row", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).alias("place")
    )
    counts = [(r["part"], r["count"]) for r in placed.groupBy("part").count().orderBy("part").collect()]
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    ends = [(part, np.cumsum(row).tolist()) for (part, _), row in zip(counts, matrix)]
    cuts = spark.createDataFrame(ends, "part long, ends array<bigint>")
    if len(ends) * (shards + 4) * 8 <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    groups = max(1, math.ceil(sum(n for _, n in counts) / shards / ROWS_PER_GROUP))
    sent = placed.join(cuts, "part").select(
        "row", "part", "place", F.expr("cast(size(filter(ends, e -> e <= place)) as int)").alias("shard"),
        F.xxhash64(F.lit(seed), "part", "place").alias("draw"),
    ).withColumn("group", F.expr(f"pmod(shiftright(draw, 20), {groups})"))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "group").count().select(
        F.col("shard").alias("of"), F.col("group").alias("in"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    ) if groups > 1 else None
    inside = F.row_number().over(Window.partitionBy("shard", "group").orderBy("draw", "part", "place")) - 1
    sent = sent.withColumn("slot", inside.cast("long"))
    if starts is not None:
        sent = sent.join(starts, (F.col("shard") == F.col("of")) & (F.col("group") == F.col("in"))).withColumn("slot", F.col("slot") + F.col("start"))
    return sent.select("row.*", "shard", "slot")

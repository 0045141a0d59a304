"""Nearest vectors by an inverted multi-index: two codebooks, a heap over centroid pairs, exact rerank."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.core import materialize

#: Codebooks are fitted on about this many vectors.
SAMPLE = 20_000
#: Centroid pairs are read until they hold this share of the different vectors. Vectors without
#: clusters (the tables at hand: nearest cosines of 0.4) need half for a recall of 0.95; clustered
#: ones need far less.
SHARE = 0.5
MOST_CENTROIDS = 64
PER_CELL = 3
#: Different vectors that one task group compares.
PER_BIN = 4_000
KMEANS_ROUNDS = 12


def kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(KMEANS_ROUNDS):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def cells_in_order(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells of one query by rising sum of the two distances, until they hold enough vectors.

    The heap starts at the nearest pair; a pair's two followers enter when it leaves.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _matrix(column) -> np.ndarray:
    """Vectors as rows, each brought near 1 by a power of two: exact, and no square overflows."""
    x = np.array(column.tolist(), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) and x.shape[1] else x


def nearest(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that `queries` picks.

    Nearness is the cosine in double precision of the original vectors; ties go to the
    smaller vec_id; a query's own vec_id is no candidate. Every vector is indexed;
    the codebooks come from a bounded sample.

    Equal vectors are one entry with their k + 1 smallest ids: no more of them can be in
    a result. A crowded cell is spread over several groups, each giving its k best.

    Left out, as query and as candidate: vectors null, zero or with null or non-finite
    components, rows without vec_id, and vectors of another length than most. Repeated rows count
    once. Fewer candidates than k: all of them. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )
    by_size = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not by_size:
        return spark.createDataFrame([], result)
    d = by_size[0]["d"]
    half = max(1, d // 2)
    valid = materialize(valid.where(F.size("v") == d).distinct(), "valid")
    row = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = materialize(
        valid.withColumn("r", row).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .select("v", "ids", F.monotonically_increasing_id().alias("n")),
        "vectors",
    )
    n = entries.count()
    centroids = int(min(MOST_CENTROIDS, max(2, 2 ** round(math.log2(math.sqrt(max(n, 4) / PER_CELL))))))
    picked = min(1.0, SAMPLE / n)
    sample = _matrix(entries.where(F.pmod(F.xxhash64("n"), F.lit(1 << 20)) < picked * (1 << 20)).orderBy("n").select("v").toPandas()["v"]) if n > 1 else _matrix(entries.select("v").toPandas()["v"])
    if not len(sample):
        sample = _matrix(entries.limit(SAMPLE).select("v").toPandas()["v"])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    books = [kmeans(sample[:, :half].copy(), centroids, 7), kmeans(sample[:, half:].copy(), centroids, 8)] if d > 1 else [kmeans(sample, centroids), np.zeros((1, 0))]
    shared = spark.sparkContext.broadcast(books)

    def distances(v: np.ndarray) -> list[np.ndarray]:
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        return [((x[:, None, :] - c) ** 2).sum(axis=2) for x, c in zip((unit[:, :half], unit[:, half:]), shared.value)]

    def assign(frames):
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                a, b = distances(_matrix(part["v"]))
                yield part.assign(cell=(a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)).astype(np.int64))

    indexed = materialize(entries.mapInPandas(assign, "v array<double>, ids array<bigint>, n long, cell long"), "index")
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most centroids squared
        sizes[r["cell"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // PER_BIN))
    loads = np.where(chunks == 1, sizes, PER_BIN)
    bins, at, load = np.zeros(len(sizes), np.int64), 0, 0
    for c in range(len(sizes)):
        if chunks[c] > 1 or load + loads[c] > PER_BIN:
            at, load = at + 1, 0
        bins[c] = at
        load += int(loads[c])
        if chunks[c] > 1:
            at, load = at + int(chunks[c]), 0
    layout = spark.sparkContext.broadcast((sizes, chunks, bins))
    wanted = max(k + 1, math.ceil(share * n))

    def place(frames):
        for f in frames:
            _, chunks, bins = layout.value
            cell = f["cell"].to_numpy()
            yield f.assign(bin=bins[cell] + f["n"].to_numpy() % chunks[cell])

    def probe(frames):
        sizes, chunks, bins = layout.value
        for f in frames:
            for at in range(0, len(f), 500):
                part = f.iloc[at : at + 500]
                a, b = distances(_matrix(part["v"]))
                rows = []
                for query, v, x, y in zip(part["vec_id"], part["v"], a, b):
                    cells = np.array(cells_in_order(x, y, sizes, wanted), np.int64)
                    where = np.repeat(bins[cells], chunks[cells]) + np.concatenate([np.arange(c) for c in chunks[cells]])
                    spread = np.repeat(cells, chunks[cells])
                    order = np.argsort(where, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                        rows.append((query, v, spread[own], int(where[own[0]])))
                yield pd.DataFrame(rows, columns=["query_id", "q", "cells", "bin"])

    def compare(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(probes) and len(held):
            cells, vectors, ids = held["cell"].to_numpy(), _matrix(held["v"]), held["ids"].to_numpy()
            lengths = np.sqrt((vectors * vectors).sum(axis=1))
            for query, q, own in zip(probes["query_id"], probes["q"], probes["cells"]):
                at = np.flatnonzero(np.isin(cells, own))
                q = _matrix(pd.Series([q]))[0]
                scores = (vectors[at] * q).sum(axis=1) / (lengths[at] * np.sqrt((q * q).sum()))
                # the query's own vector may be among the first k + 1; ties stay in
                best = np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k else -np.inf
                found = sorted((-scores[i], int(x)) for i in np.flatnonzero(scores >= best) for x in ids[at[i]] if x != query)
                out += [(query, x, -s) for s, x in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # few and small rows, but much work on each: dealt over the tasks
    asked = valid.where(queries).dropDuplicates(["vec_id"]).repartition(spark.sparkContext.defaultParallelism, "vec_id")
    probes = asked.mapInPandas(probe, "query_id long, q array<double>, cells array<bigint>, bin long")
    held = indexed.mapInPandas(place, "v array<double>, ids array<bigint>, n long, cell long, bin long")
    found = probes.groupBy("bin").cogroup(held.groupBy("bin")).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Clustering by integer centroids; the nearest one is found by the threshold algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm.common import Batches, batch_of, map_arrow

#: Integer components stay within this, so a squared distance of 64 components fits 63 bits.
LARGEST = 1 << 27
#: Vectors that are walked together.
TOGETHER = 2_048
FAR = np.iinfo(np.int64).max


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the smaller number), and its squared distance.

    Every dimension has its centroids in order of value, and is walked outward from the row's
    own value, nearest first. A centroid met in any dimension gets its exact distance. The
    squared gaps at the frontier add up to a bound of what no dimension has met yet; a row is
    done when that sum strictly exceeds its best distance (an equal one may still hide a
    smaller number), or when it has met all centroids.
    """
    k, d = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    ranked = np.take_along_axis(centroids, order, axis=0)
    dims = np.arange(d)
    right = np.stack([np.searchsorted(ranked[:, j], x[:, j]) for j in dims], axis=1)
    left = right - 1
    exact = np.full((len(x), k), FAR)
    rows = np.arange(len(x))
    while len(rows):
        own, lo, hi = x[rows], left[rows], right[rows]
        below = np.where(lo >= 0, own - ranked[np.maximum(lo, 0), dims], FAR)
        above = np.where(hi < k, ranked[np.minimum(hi, k - 1), dims] - own, FAR)
        down = below <= above
        gap = np.where(down, below, above)
        met = np.zeros((len(rows), k), bool)
        met[np.arange(len(rows))[:, None], order[np.where(down, lo, hi), dims]] = True
        left[rows], right[rows] = lo - down, hi + ~down
        at, new = np.nonzero(met & (exact[rows] == FAR))
        exact[rows[at], new] = ((own[at] - centroids[new]) ** 2).sum(axis=1)
        known = exact[rows]
        rows = rows[((gap * gap).sum(axis=1) <= known.min(axis=1)) & (known == FAR).any(axis=1)]
    return exact.argmin(axis=1), exact.min(axis=1)


def _kept(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose vector takes part, and their integer components."""
    column = batch.column("v")
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) * scale
    fit = (np.abs(x) <= LARGEST).all(axis=1)  # false for NaN (also what null becomes) and infinity
    return batch.filter(pa.array(fit)), np.floor(x[fit]).astype(np.int64)


def _walked(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [nearest(x[i : i + TOGETHER], centroids) for i in range(0, len(x), TOGETHER)]
    return tuple(np.concatenate(p) if p else np.empty(0, np.int64) for p in (list(zip(*parts)) or [(), ()]))


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def seeds(vectors: DataFrame, k: int, dims: int, scale: int, salt: int = 1) -> np.ndarray:
    """The k kept vectors with the smallest SHA-256 of `salt:vec_id`; rows without vec_id come last, equal ids by value."""

    def whole(batches: Batches) -> Batches:
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))])
        for batch in batches:
            rows, x = _kept(batch, dims, scale)
            yield batch_of(schema, rows.column("vec_id"), list(x))

    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = map_arrow(_plain(vectors), whole, "vec_id long, v array<long>").orderBy(F.asc_nulls_last(drawn), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64).reshape(-1, dims)


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: int = 1) -> np.ndarray:
    """Integer centroids after some rounds: each non-empty one becomes the floor of its vectors' mean.

    Tasks add up their vectors by centroid; the driver gets k rows a round.
    """
    centroids = seeds(vectors, k, dims, scale, salt)
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
    for _ in range(rounds if len(centroids) else 0):

        def add_up(batches: Batches, now=centroids) -> Batches:
            count, total = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for batch in batches:
                _, x = _kept(batch, dims, scale)
                near, _ = _walked(x, now)
                count += np.bincount(near, minlength=len(now))
                np.add.at(total, near, x)
            own = np.flatnonzero(count)
            yield batch_of(schema, own.astype(np.int32), count[own], list(total[own]))

        parts = map_arrow(_plain(vectors), add_up, "cluster int, n long, total array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(dims)])
        centroids = centroids.copy()
        for row in sums.collect():
            centroids[row["cluster"]] = [row[f"t{j}"] // row["n"] for j in range(dims)]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared) of every kept vector."""

    def place(batches: Batches) -> Batches:
        schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
        for batch in batches:
            rows, x = _kept(batch, dims, scale)
            near, distance = _walked(x, centroids)
            yield batch_of(schema, rows.column("vec_id"), near.astype(np.int32), distance)

    return map_arrow(_plain(vectors), place, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: int = 1) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, and its centroid's components.

    Vectors of exactly `dims` components take part, each component x as floor(scale * x).
    Left out: null vectors, other lengths, vectors with a null or non-finite component, and
    vectors whose scaled components lie beyond 2^27, for which squared distances and their
    sums have no room in 64 bits. Rows without vec_id take part but become first centroids
    only after all others. Repeated rows count as often as they stand there. Fewer vectors than k: as many
    centroids. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    centroids = fit(vectors, k, rounds, dims, scale, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    placed = materialize(assign(vectors, centroids, dims, scale), "placed")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = spark.createDataFrame(
        [(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def centroid_digest(components: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()

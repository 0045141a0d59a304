"""Near vectors by lattice hashing: random projections decoded to E8 points in several tables, neighbours probed."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm.common import Batches, batch_of, components, map_arrow
from gristmill.llm.neardup import mix

SIMILAR = 0.98
#: Neighbouring cells that each vector probes in a table.
PROBES = 4
#: Tables are added until a pair at the limit is missed by all of them with at most this chance.
MISSED = 0.001
#: Members of a cell beyond this are dealt into parts, and every two parts are compared by a task of their own.
PART = 2_048
#: Cells up to this size are compared row by row, larger ones by matrix products.
FEW = 24
#: Bits of the sign sketch that members of a cell are compared by before their vectors are fetched.
BITS = 128
#: Similarities this near to the limit are computed again with exact sums.
CLOSE = 1e-12
_ODD = np.random.default_rng(13).integers(1, 1 << 62, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of the lattice: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([out, halves[(halves < 0).sum(axis=1) % 2 == 0]])


NEIGHBOURS = _minimal()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: where the rounded sum is odd, the worst rounded entry goes the other way."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: even integers, or the same shifted by one half."""
    whole, shifted = _even_integers(x), _even_integers(x - 0.5) + 0.5
    near = ((x - whole) ** 2).sum(axis=1) <= ((x - shifted) ** 2).sum(axis=1)
    return np.where(near[:, None], whole, shifted)


def _number(points: np.ndarray) -> np.ndarray:
    return mix(((2 * points).astype(np.int64).view(np.uint64) * _ODD).sum(axis=-1, dtype=np.uint64))


@lru_cache(maxsize=256)
def projection(d: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Random orthonormal map to eight dimensions, and a random shift of the lattice."""
    rng = np.random.default_rng([d, table])
    return np.linalg.qr(rng.standard_normal((max(d, 8), 8)))[0][:d], rng.random(8)


def scale_of(spread: float, d: int, similar: float) -> float:
    """Scale at which a pair at the limit is projected to points about `spread` apart."""
    return spread / (math.sqrt(2 - 2 * similar) * math.sqrt(8 / max(d, 8)))


def cells(unit: np.ndarray, table: int, scale: float, probes: int = PROBES) -> np.ndarray:
    """Own cell and the nearest neighbouring cells of each unit vector, as rows of hashes."""
    turn, shift = projection(unit.shape[1], table)
    y = unit @ turn * scale + shift
    point = nearest_point(y)
    # squared distance to a neighbour's centre grows with 1 - residual . neighbour
    nearness = (y - point) @ NEIGHBOURS.T
    near = np.argpartition(nearness, -probes, axis=1)[:, len(NEIGHBOURS) - probes :]
    return _number(np.concatenate([point[:, None], point[:, None] + NEIGHBOURS[near]], axis=1))


def sketch(unit: np.ndarray) -> np.ndarray:
    """Signs of random projections, as rows of 64-bit numbers."""
    planes = _planes(unit.shape[1])
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


@lru_cache(maxsize=256)
def _planes(d: int) -> np.ndarray:
    return np.random.default_rng([d, BITS]).standard_normal((d, BITS))


def most_unequal(similar: float) -> int:
    """Sketch bits that a pair at the limit may differ in: six deviations above what is expected."""
    p = math.acos(min(1.0, similar)) / math.pi
    return math.ceil(BITS * p + 6 * math.sqrt(BITS * p * (1 - p)))


def plan(n: int, d: int, similar: float = SIMILAR, missed: float = MISSED, probes: int = PROBES) -> tuple[float, int]:
    """Spread and number of tables for n vectors: cells get finer as n grows, and tables are added to keep the recall.

    The chance to miss a pair at the limit is measured on random pairs of that similarity.
    """
    spread = 0.3 + 0.03 * math.log2(max(1.0, n / 2_000))
    rng, d = np.random.default_rng(5), min(max(d, 8), 256)
    x, side = rng.standard_normal((2, 3_000, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = similar * x + math.sqrt(1 - similar**2) * side
    a, b = (cells(z, 0, scale_of(spread, d, similar), probes) for z in (x, y))
    one = 1 - ((a[:, :1] == b) | (a == b[:, :1])).any(axis=1).mean()
    return spread, 2 if one <= 0 else max(2, math.ceil(math.log(missed) / math.log(one)))


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


class Roots:
    """Groups of numbered items that grow together; each is known by its smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.of, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.of != self.of[self.of]).any():
                self.of = self.of[self.of]


_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _blocks(batches: Batches) -> Batches:
    """Batches in order of (cell, lo, hi), cut so that no block is parted."""
    rest = None
    for batch in batches:
        whole = pa.Table.from_batches([*([rest] if rest is not None else []), batch]).combine_chunks().to_batches()
        if not whole:
            continue
        batch = whole[0]
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "lo", "hi")])
        last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _columns(batch: pa.RecordBatch, *names: str) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}


def _bounds(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    border = np.flatnonzero((np.diff(rows["cell"]) != 0) | (np.diff(rows["lo"]) != 0) | (np.diff(rows["hi"]) != 0)) + 1
    begin = np.concatenate([[0], border])
    return begin, np.append(begin[1:], len(rows["cell"]))


def _comparable(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of which one lies in the cell, and which no other two parts of the cell compare."""
    return (rows["home"][i] | rows["home"][j]) & ((rows["lo"][i] == rows["hi"][i]) | (rows["part"][i] != rows["part"][j]))


_MATED = pa.schema([("id", pa.int64()), ("cell", pa.int64()), ("home", pa.bool_()), ("part", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _sifter(unequal: int):
    """Task over rows in order of their block: those that have a mate whose sketch is near."""

    def task(batches: Batches) -> Batches:
        for batch in _blocks(batches):
            rows = _columns(batch, "cell", "lo", "hi", "part", "home")
            bits = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], axis=1)
            begin, end = _bounds(rows)
            block = np.repeat(np.arange(len(begin)), end - begin)
            mated = np.zeros(batch.num_rows, bool)

            def mate(i: np.ndarray, j: np.ndarray) -> None:
                keep = _comparable(rows, i, j)
                mated[i[keep]] = mated[j[keep]] = True

            small = np.flatnonzero((end - begin)[block] <= FEW)
            for step in range(1, FEW):
                at = np.flatnonzero(block[small[:-step]] == block[small[step:]]) if len(small) > step else []
                if not len(at):
                    break
                i, j = small[at], small[at + step]
                near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= unequal
                mate(i[near], j[near])
            for b in np.flatnonzero(end - begin > FEW):
                tile = max(1, 500_000 // int(end[b] - begin[b]))
                for at in range(begin[b], end[b], tile):
                    stop = min(at + tile, end[b])
                    gaps = np.bitwise_count(bits[at:stop, None, 0] ^ bits[None, at : end[b], 0]) + np.bitwise_count(bits[at:stop, None, 1] ^ bits[None, at : end[b], 1])
                    i, j = np.nonzero(np.triu(gaps <= unequal, 1))
                    mate(at + i, at + j)
            yield batch.select(_MATED.names).filter(pa.array(mated)).cast(_MATED)

    return task


def _linker(similar: float, tables: int):
    """Task over rows in order of their block: per row its links found there, and one row of its group.

    A pair may meet in several blocks. It counts in the first table in which it meets, in the own
    cell of the row with the smaller id if the other one looks there, else in the other's.
    """

    def linked(rows: dict, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        keep = _comparable(rows, i, j) & (rows["grp"][i] == rows["grp"][j])
        keep &= cosine >= similar - CLOSE
        for at in np.flatnonzero(keep & (cosine < similar + CLOSE)):
            keep[at] = _exact(rows["unit"][i[at]], rows["unit"][j[at]]) >= similar
        at = np.flatnonzero(keep)
        first = rows["id"][i[at]] < rows["id"][j[at]]
        x, y = np.where(first, i[at], j[at]), np.where(first, j[at], i[at])
        cx, cy = rows["cells"][x], rows["cells"][y]
        at_x, at_y = (cy == cx[:, :, :1]).any(axis=2), (cx == cy[:, :, :1]).any(axis=2)
        table = (at_x | at_y).argmax(axis=1)
        k = np.arange(len(at))
        where = np.where(at_x[k, table], cx[k, table, 0], cy[k, table, 0])
        keep[at] = where == rows["cell"][i[at]]
        return keep

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        rows = _columns(batch, "cell", "lo", "hi", "part", "id", "home", "grp", "copies")
        rows["cells"] = batch.column("cells").flatten().to_numpy().reshape(n, tables, -1)
        sizes = pc.list_value_length(batch.column("unit")).to_numpy()
        flat, starts = batch.column("unit").flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        begin, end = _bounds(rows)
        links, roots = np.zeros(n, np.int64), Roots(n)

        def count(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
            keep = linked(rows, i, j, cosine)
            i, j = i[keep], j[keep]
            np.add.at(links, i, rows["copies"][j])
            np.add.at(links, j, rows["copies"][i])
            roots.join(i, j)

        for d in np.unique(sizes):  # vectors of one length at a time: others share no cell
            own = np.flatnonzero(sizes == d)
            unit = flat[(starts[own][:, None] + np.arange(d))]
            rows["unit"] = np.zeros((n, d)) if len(own) < n else unit
            if len(own) < n:
                rows["unit"][own] = unit
            block = np.repeat(np.arange(len(begin)), end - begin)
            small = own[(end - begin)[block[own]] <= FEW]
            for step in range(1, FEW):
                at = np.flatnonzero(block[small[:-step]] == block[small[step:]]) if len(small) > step else []
                if not len(at):
                    break
                i, j = small[at], small[at + step]
                count(i, j, np.einsum("ij,ij->i", rows["unit"][i], rows["unit"][j]))
            for b in np.flatnonzero(end - begin > FEW):
                inside = own[(own >= begin[b]) & (own < end[b])]
                tile = max(1, 100_000 // max(1, len(inside)))
                for at in range(0, len(inside), tile):
                    cosine = rows["unit"][inside[at : at + tile]] @ rows["unit"][inside[at:]].T
                    i, j = np.nonzero(np.triu(cosine >= similar - CLOSE, 1))
                    count(inside[at + i], inside[at + j], cosine[i, j])
        met = np.flatnonzero(links)
        return batch_of(_FOUND, rows["id"][met], links[met], rows["id"][roots.of[met]])

    def task(batches: Batches) -> Batches:
        for batch in _blocks(batches):
            yield compare(batch)

    return task


def _index(scale_spread: float, similar: float, tables: int, probes: int):
    schema = pa.schema([("id", pa.int64()), ("grp", pa.int64()), ("copies", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("unit", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))])

    def task(batches: Batches) -> Batches:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(sizes):
                own = batch.filter(pa.array(sizes == d))
                unit = unit_rows(own.column("v").flatten().to_numpy().reshape(-1, d))
                grp = own.column("grp").to_numpy()
                keys = [mix(cells(unit, t, scale_of(scale_spread, d, similar), probes) + mix(grp.view(np.uint64) + np.uint64(t))[:, None]) for t in range(tables)]
                found = np.concatenate(keys, axis=1).view(np.int64)
                yield batch_of(schema, own.column("id"), own.column("grp"), own.column("copies"), *sketch(unit).T, list(unit), list(found))

    return task


def near_vectors(vectors: DataFrame, similar: float = SIMILAR, probes: int = PROBES, missed: float = MISSED) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors of equal label are linked at a cosine (double precision) of `similar` or more, if
    they meet in a table: one lies in a cell that the other lies in or probes. Equal vectors
    are one entry with a number of copies. Members of a cell are first compared by short sign
    sketches, and vectors are fetched only for those that have a mate near enough. Tasks then
    compare them in blocks and pass on only numbers: the links of each, and one member of its
    group. No pair is written; a crowded cell is dealt into parts, whose pairs are different tasks.

    A table multiplies a unit vector by a random map to eight dimensions and takes the
    nearest E8 point; `plan` chooses how fine, and how many tables.

    Linked with nothing (n_links 0, own component): vectors null, empty, zero or with null
    or non-finite components; rows without label or vec_id. Vectors of unequal length are
    not compared. Repeated rows count as one vector and each get its result; one vec_id with
    several vectors is several. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = "vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    keyed = rows.withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)))
    keyed = keyed.withColumn("h1", F.expr("if(usable, xxhash64(label, v), null)")).withColumn("h2", F.expr("if(usable, xxhash64(13, label, v), null)"))
    entries = keyed.where("usable").select("vec_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    entries = materialize(entries.select("*", F.monotonically_increasing_id().alias("id")), "entries")
    valued = keyed.where("usable").groupBy("vec_id", "label", "v", "h1", "h2").agg(F.lit(1).alias("one"))
    valued = valued.join(entries, ["h1", "h2", "vec_id"]).select("id", F.xxhash64("label", F.size("v")).alias("grp"), "copies", "v")
    valued = materialize(valued, "vectors")
    by_group = valued.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).orderBy(F.desc("n"), "grp").limit(1).collect()
    if not by_group:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    spread, tables = plan(by_group[0]["n"], by_group[0]["d"], similar, missed, probes)
    index = materialize(map_arrow(valued, _index(spread, similar, tables, probes), "id long, grp long, copies long, s0 long, s1 long, unit array<double>, cells array<long>"), "index")

    met = index.select("id", "s0", "s1", F.posexplode("cells").alias("k", "cell")).select("id", "s0", "s1", "cell", (F.col("k") % (probes + 1) == 0).alias("home"))
    shared = met.groupBy("cell").agg(F.count("*").alias("members"), F.count_if("home").alias("homes")).where("members > 1 and homes > 0")
    shared = materialize(shared.select("cell", F.ceil(F.col("members") / PART).cast("int").alias("parts")), "cells")
    part = F.expr("cast(pmod(xxhash64(id), parts) as int)")
    placed = met.join(shared, "cell").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("id", "s0", "s1", "cell", "home", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    in_blocks = lambda df: df.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "id")
    mated = map_arrow(in_blocks(placed), _sifter(most_unequal(similar)), "id long, cell long, home boolean, part int, lo int, hi int")
    blocks = in_blocks(materialize(mated, "mated").join(index.drop("s0", "s1"), "id"))
    found = materialize(map_arrow(blocks, _linker(similar, tables), "id long, links long, root long"), "links")

    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = entries.join(counted, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "h1", "h2", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("group"),
    )
    least = told.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    told = materialize(told.join(least, "group").select("h1", "h2", "n_links", "component_id"), "told")
    out = keyed.select("vec_id", "h1", "h2").join(told, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )

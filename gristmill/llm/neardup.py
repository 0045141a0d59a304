"""Near copies by HyperMinHash: compressed registers, banding, corrected estimate, full check."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm.common import Batches, batch_of, components, map_arrow, text_bytes

REGISTERS = 128  # buckets of the shingle hash
MANTISSA = 10  # bits kept behind the leading one
PER_BAND = 4  # 16-bit registers in a band: a band is one 64-bit number
BANDS = REGISTERS // PER_BAND
WORDS = 5
SIMILAR = 75  # per cent
#: Pairs whose corrected estimate is below are not checked in full. Estimates at 0.75 deviate by at
#: most 0.043, for small sets too: their registers are borrowed evenly from all they have.
ESTIMATE_LEAST = 0.5
#: Shingles that more members lack in their centre are counted to the centre.
USUAL = 32
MASK = (1 << 64) - 1
#: Words whose hashes a task keeps (about 150 bytes each).
KNOWN = 200_000

_MULTIPLIERS = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(WORDS)], np.uint64)
#: Each empty bucket borrows from the first filled one of its own fixed order.
_ORDERS = np.argsort(np.random.default_rng(8).random((REGISTERS, REGISTERS)), axis=1)
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - 7)


class WordHashes(dict):
    """64-bit hashes of words, computed when first seen; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; fewer words make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return mix(np.array([int(sum(int(x) * int(m) for x, m in zip(h, _MULTIPLIERS)) + n) & MASK], np.uint64))
    s = h[: n - WORDS + 1] * _MULTIPLIERS[0]
    for i in range(1, WORDS):
        s += h[i : n - WORDS + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mix(s))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Per bucket of a sorted hash set: leading zeros of its smallest rest, then the bits behind the one."""
    first = np.searchsorted(hashes, _EDGES)
    filled = np.diff(np.append(first, len(hashes))) > 0
    rest = hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(7)
    _, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    zeros = 53 - exponent
    tail = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | tail.astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _ORDERS[empty]
        out[empty] = out[order[np.arange(len(empty)), np.argmax(filled[order], axis=1)]]
    return out


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that two unrelated sets of a and b elements show the same register in a bucket."""
    a, b = np.asarray(a, float)[:, None] / REGISTERS, np.asarray(b, float)[:, None] / REGISTERS
    high = 2.0 ** -np.arange(0, 57)
    low = high / 2
    width = low / (1 << MANTISSA)
    total = a + b
    return (width * a * b / total * (np.exp(-total * low) - np.exp(-total * high))).sum(axis=1)


def estimated(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows x and y of sets with a and b elements, collisions taken off."""
    chance = collision_rate(a, b)
    return np.maximum((x == y).mean(axis=1) - chance, 0) / (1 - chance)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("th1", pa.int64()), ("th2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Batches) -> Batches:
    known = WordHashes()
    for batch in batches:
        sizes, keys, bands = [], [], []
        for text in text_bytes(batch.column("text")):
            s = shingle_hashes(text.lower().split() if text else [], known)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(registers(s).view(np.int64) if len(s) else None)
            if len(known) > KNOWN:
                known.clear()
        yield batch_of(_SIGNED, batch.column("doc_id"), sizes, keys, batch.column("th1"), batch.column("th2"), bands)


def _estimate(batches: Batches) -> Batches:
    for batch in batches:
        lanes = [
            batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS) if batch.num_rows else np.empty((0, REGISTERS), np.uint16)
            for c in ("bands_a", "bands_b")
        ]
        a, b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        keep = estimated(*lanes, a, b) >= ESTIMATE_LEAST if batch.num_rows else np.empty(0, bool)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def shingle_set(text: bytes) -> set:
    w = text.lower().split()
    return {tuple(w)} if 0 < len(w) < WORDS else set(zip(*(w[i:] for i in range(WORDS))))


def _confirm(batches: Batches) -> Batches:
    for batch in batches:
        seen: tuple = (None, None)
        keep = []
        for i, left, right in zip(batch.column("a").to_pylist(), text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b"))):
            if seen[0] != i:
                seen = (i, shingle_set(left))
            x, y = seen[1], shingle_set(right)
            both = len(x & y)
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart_from_centre(batches: Batches) -> Batches:
    """Per member: the number of shingles it shares with its centre, and hashes of the others."""
    known, seen = WordHashes(), (None, None)
    for batch in batches:
        common, beyond = [], []
        for centre, left, right in zip(batch.column("centre").to_pylist(), text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b"))):
            if seen[0] != centre:
                seen = (centre, shingle_hashes(left.lower().split(), known))
            mine = shingle_hashes(right.lower().split(), known)
            other = np.setdiff1d(mine, seen[1], assume_unique=True)
            common.append(len(mine) - len(other))
            beyond.append(other.view(np.int64))
            if len(known) > KNOWN:
                known.clear()
        yield batch_of(_APART, *(batch.column(c) for c in ("centre", "id", "n", "label")), common, beyond)


_APART = pa.schema([(c, pa.int64()) for c in ("centre", "id", "n", "label", "common")] + [("beyond", pa.list_(pa.int64()))])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts with equal shingle sets form a class; classes are linked when at least
    75 % of the union of their five-word shingles is shared, as confirmed on the
    texts. Candidates agree on one of 32 bands of four registers (two sets of
    similarity 0.75 miss all bands with a chance of 5 in a million). In each
    bucket the members are first held against its centre, the member with most
    bucket mates (edits of one text agree with that text more than with each
    other), and its smallest one, so a large group of copies costs as many pairs
    as it has members. Members that are then still in different components are
    paired by shingles beyond their centre and what is usual around it: a pair
    that shares less of those than a link takes must have others in common, and
    one among the first n - (75 % of n) + 1 in a fixed order of each. Only pairs
    that the usual shingles alone could link are paired without one.

    Null text and text without words: n_shingles 0, its own component. Null
    doc_id: it counts for links but not for the smallest id; alone, it keeps null.
    Repeated rows get equal results. Empty table: no rows. Other columns are not read.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.xxhash64("text").alias("th1"), F.xxhash64(F.lit(8), "text").alias("th2"),
    )
    signed = materialize(map_arrow(docs, _sign, "doc_id long, n_shingles long, set_key binary, th1 long, th2 long, bands array<bigint>"), "signatures")
    classes = materialize(
        signed.where("set_key is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
            F.min(F.struct("th1", "th2")).alias("th"),
        ).select(F.monotonically_increasing_id().alias("id"), "set_key", "least", "n", "bands", "th.th1", "th.th2"),
        "classes",
    )
    entries = classes.select("id", "n", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id", "n")
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(entries.join(buckets, "bucket"), "members")
    ranked = members.join(members.groupBy("id").agg(F.sum("members").alias("mates")), "id")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("mates", "id"))["id"].alias("centre"), F.min("id").alias("low"))
    texts = materialize(
        docs.select("th1", "th2", "text")
        .join(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "th1", "th2"), ["th1", "th2"])
        .groupBy("id").agg(F.first("text").alias("text")),
        "texts",
    )

    def pairs(x: DataFrame) -> DataFrame:
        return x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def confirmed(candidates: DataFrame) -> DataFrame:
        of = lambda end: classes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("bands").alias(f"bands_{end}"))
        sized = candidates.join(of("a"), "a").join(of("b"), "b").where(f"100 * least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b)")
        likely = map_arrow(sized.select("a", "b", "n_a", "n_b", "bands_a", "bands_b"), _estimate, "a long, b long")
        words = lambda end: texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}"))
        return map_arrow(likely.join(words("b"), "b").join(words("a"), "a").select("a", "b", "text_a", "text_b"), _confirm, "a long, b long")

    spokes = members.join(centres, "bucket").select(F.col("id").alias("a"), F.explode(F.array("centre", "low")).alias("b"))
    first = materialize(pairs(spokes), "pairs")
    links = materialize(confirmed(first), "confirmed")
    labels = components(links)

    placed = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label"))
    apart = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    placed = placed.join(apart.join(centres, "bucket"), "bucket").where("id <> centre").select("centre", "id", "n", "label").distinct()
    words = lambda end, name: texts.select(F.col("id").alias(end), F.col("text").alias(name))
    told = placed.join(words("id", "text_b"), "id").join(words("centre", "text_a"), "centre")
    told = map_arrow(told, _apart_from_centre, "centre long, id long, n long, label long, common long, beyond array<bigint>")
    told = materialize(told, "apart")
    other = told.select("centre", "id", "n", "label", "common", F.explode_outer("beyond").alias("shingle"))
    usual = other.groupBy("centre", "shingle").agg(F.count("*").alias("holders")).where(f"holders > {USUAL}")
    told = materialize(
        other.join(usual, ["centre", "shingle"], "left").groupBy("centre", "id", "n", "label").agg(
            (F.first("common") + F.count("holders")).alias("common"),
            F.array_sort(F.collect_list(F.expr("if(holders is null, shingle, null)"))).alias("beyond"),
        ).withColumn("beyond", F.slice("beyond", F.lit(1), (F.col("n") - F.ceil(SIMILAR * F.col("n") / 100) + 1).cast("int"))),
        "apart",
    )
    kept = ("id", "n", "label", "common")
    side = lambda end, *more: told.select("centre", *more, *[F.col(c).alias(f"{c}_{end}") for c in kept])
    differ = f"label_a < label_b and 100 * least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b)"
    covered = f"{100 + SIMILAR} * least(common_a, common_b) >= {SIMILAR} * (n_a + n_b)"
    shingle = F.explode("beyond").alias("shingle")
    sharing = side("a", shingle).join(side("b", shingle), ["centre", "shingle"]).where(f"{differ} and not ({covered})")
    within = [side(end).where(f"100 * common_{end} >= {SIMILAR} * n_{end}") for end in "ab"]
    inside = within[0].join(within[1], "centre").where(f"{differ} and {covered}")
    rest = sharing.select("id_a", "id_b").unionByName(inside.select("id_a", "id_b"))
    second = materialize(pairs(rest.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).join(first, ["a", "b"], "left_anti"), "pairs")
    more = materialize(confirmed(second), "confirmed")
    labels = components(links.unionByName(more))

    placed = classes.select("id", "set_key", "least").join(labels.withColumnRenamed("node", "id"), "id", "left").select("set_key", "least", F.coalesce("label", "id").alias("label"))
    lowest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "label").select("set_key", "component_id")
    return signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""Token ids of a corpus in wavelet matrices: one per shard, with access, rank and select."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm.common import Batches, WordTokenizer, batch_of, in_slices, map_arrow, task_number

BITS = 16
END = 2
#: A shard closes behind the document that brings it to this many ids.
SHARD_TOKENS = 1 << 20
#: Bits between two stored ranks.
STRIDE = 512
#: Bits of a plane that are compressed together: what one access inflates of it.
BLOCK = 1 << 17
#: Bits of a plane that are parted together.
TOGETHER = 1 << 15
MAGIC = b"WMX2"


def _parted(ones: np.ndarray, zeros: int):
    """Stretch by stretch, small enough for a core's cache: its start, the places of its zeros and ones in it,
    and where these stand when all zeros come first."""
    first, second = 0, zeros
    for a in range(0, len(ones), TOGETHER):
        part = ones[a : a + TOGETHER]
        low, high = np.flatnonzero(~part), np.flatnonzero(part)
        yield a, low, high, first, second
        first, second = first + len(low), second + len(high)


class WaveletMatrix:
    """Sequence of ids below 2^16 as bit planes, high bit first, zeros of each plane moved to the front.

    File: MAGIC, number of ids, zeros of each plane; then for each plane the ranks at every
    512 bits, the end of each compressed block, and the blocks (zstd, little-endian bit
    strings of 2^17 bits). Opening a file reads the head of each plane only; access, rank and select
    inflate the blocks they touch, one of each plane is kept.
    """

    def __init__(self, size: int, zeros: np.ndarray, ranks: list[np.ndarray], blocks: list[list]):
        self.size, self.zeros, self.ranks, self.blocks = size, zeros, ranks, blocks
        self._open: dict[int, tuple[int, np.ndarray]] = {}
        self.inflated = 0  # blocks inflated so far

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        now, zeros, ranks, blocks = ids.astype(np.uint16), [], [], []
        then = np.empty_like(now)
        for bit in range(BITS - 1, -1, -1):
            ones = (now & np.uint16(1 << bit)) != 0
            bits = np.packbits(ones, bitorder="little")
            whole = np.zeros(-(-len(bits) // (STRIDE // 8)) * (STRIDE // 8), np.uint8)
            whole[: len(bits)] = bits
            count = np.bitwise_count(whole.view(np.uint64)).reshape(-1, STRIDE // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.cumsum(count, dtype=np.uint32) - count)
            blocks.append([pa.compress(whole[at : at + BLOCK // 8], codec="zstd", asbytes=True) for at in range(0, len(whole), BLOCK // 8)])
            zeros.append(len(now) - int(count.sum()))
            for a, low, high, first, second in _parted(ones, zeros[-1]):
                np.take(now[a : a + TOGETHER], low, out=then[first : first + len(low)])
                np.take(now[a : a + TOGETHER], high, out=then[second : second + len(high)])
            now, then = then, now
        return cls(len(ids), np.array(zeros, np.uint64), ranks, blocks)

    def dump(self) -> bytes:
        parts = [MAGIC, struct.pack("<Q", self.size), self.zeros.tobytes()]
        for ranks, blocks in zip(self.ranks, self.blocks):
            parts += [ranks.tobytes(), np.cumsum([len(b) for b in blocks], dtype=np.uint32).tobytes(), *blocks]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> "WaveletMatrix":
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (size,) = struct.unpack_from("<Q", data, 4)
        zeros = np.frombuffer(data, np.uint64, BITS, 12)
        at, ranks, blocks, view = 12 + 8 * BITS, [], [], memoryview(data)
        strides, many = -(-size // STRIDE), -(-size // BLOCK)
        for _ in range(BITS):
            ranks.append(np.frombuffer(data, np.uint32, strides, at))
            ends = np.frombuffer(data, np.uint32, many, at + 4 * strides).tolist()
            at += 4 * (strides + many)
            blocks.append([view[at + a : at + b] for a, b in zip([0, *ends], ends)])
            at += ends[-1] if ends else 0
        return cls(size, zeros, ranks, blocks)

    def _block(self, plane: int, k: int) -> np.ndarray:
        held = self._open.get(plane)
        if held is None or held[0] != k:
            strides = min(BLOCK // STRIDE, len(self.ranks[plane]) - k * (BLOCK // STRIDE))
            self.inflated += 1
            held = self._open[plane] = (k, np.frombuffer(pa.decompress(self.blocks[plane][k], strides * STRIDE // 8, codec="zstd"), np.uint8))
        return held[1]

    def bits(self, plane: int) -> np.ndarray:
        whole = [self._block(plane, k) for k in range(len(self.blocks[plane]))]
        return np.unpackbits(np.concatenate(whole), count=self.size, bitorder="little") if whole else np.empty(0, np.uint8)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now, up = np.zeros(self.size, np.uint16), np.empty(self.size, np.uint16)
        for plane in range(BITS - 1, -1, -1):
            z = int(self.zeros[plane])
            now[z:] |= np.uint16(1 << (BITS - 1 - plane))
            for a, low, high, first, second in _parted(self.bits(plane).view(bool), z):
                part = up[a : a + TOGETHER]
                part[low] = now[first : first + len(low)]
                part[high] = now[second : second + len(high)]
            now, up = up, now
        return now

    def ones_before(self, plane: int, at: int) -> int:
        if at >= self.size:
            return self.size - int(self.zeros[plane])
        block = self._block(plane, at // BLOCK)
        first = at % BLOCK // STRIDE * (STRIDE // 8)
        rest = np.unpackbits(block[first : first + STRIDE // 8], bitorder="little")
        return int(self.ranks[plane][at // STRIDE]) + int(rest[: at % STRIDE].sum())

    def access(self, at: int) -> int:
        value = 0
        for plane in range(BITS):
            ones = self.ones_before(plane, at)
            if self._block(plane, at // BLOCK)[at % BLOCK >> 3] >> (at & 7) & 1:
                value |= 1 << (BITS - 1 - plane)
                at = int(self.zeros[plane]) + ones
            else:
                at -= ones
        return value

    def _range(self, token: int, at: int) -> tuple[int, int]:
        lo, hi = 0, at
        for plane in range(BITS):
            a, b = self.ones_before(plane, lo), self.ones_before(plane, hi)
            if token >> (BITS - 1 - plane) & 1:
                lo, hi = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, at: int) -> int:
        """Occurrences of token before place at."""
        lo, hi = self._range(token, at)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0; -1 if there are fewer."""
        lo, hi = self._range(token, self.size)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for plane in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - plane) & 1
            wanted = at - int(self.zeros[plane]) if one else at
            a, b = 0, self.size  # smallest place whose count of such bits passes the wanted one
            while a < b:
                m = (a + b) // 2
                seen = self.ones_before(plane, m + 1)
                a, b = (a, m) if (seen if one else m + 1 - seen) > wanted else (m + 1, b)
            at = a
        return at

    def places(self, token: int) -> np.ndarray:
        """All places of a token, in order: its range on the lowest plane, carried up plane by plane."""
        lo, hi = self._range(token, self.size)
        at = np.arange(lo, hi)
        for plane in range(BITS - 1, -1, -1) if hi > lo else ():
            one = token >> (BITS - 1 - plane) & 1
            same = np.flatnonzero(self.bits(plane) == one)
            at = same[at - int(self.zeros[plane]) if one else at]
        return at


SHARDS = "part long, shard int, before long, n_tokens long, doc_ids array<bigint>, ends array<bigint>, matrix binary"
_SHARDS = pa.schema([("part", pa.int64()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("matrix", pa.binary())])


def write_shards(docs: DataFrame, spec: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts and write the shards to the shared folder, in ascending doc_id order.

    The documents are dealt by ranges of doc_id before they are encoded, so each range is
    encoded and written where it lies. Parts, and shards in a part, are in order of
    doc_id; before counts the ids of the part in earlier shards. Equal doc_ids are
    ordered by a hash of the text, and a doc_id with very many rows is spread over parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batches: Batches) -> Batches:
        tokenizer, part = WordTokenizer.of(shared.value), task_number()
        number, before, chunks, ids_of, ends, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            return batch_of(_SHARDS, [part], [number], [before], [size], [ids_of], [ends], [WaveletMatrix.build(np.concatenate(chunks)).dump()])

        last = np.array([end], np.uint16)
        for batch in batches:
            for some in in_slices(batch):
                ids, upto = tokenizer.encode(some.column("text"))
                upto = upto.tolist()
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), [0, *upto], upto):
                    chunks += [ids[a:b], last]
                    size += b - a + 1
                    ids_of.append(doc_id)
                    ends.append(size)
                    if size >= shard_tokens:
                        yield close()
                        number, before, chunks, ids_of, ends, size = number + 1, before + size, [], [], [], 0
        if ids_of:
            yield close()

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.rand(5).alias("draw"))
    dealt = asked.repartitionByRange("doc_id", "tie", "draw").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(map_arrow(dealt, encode, SHARDS), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards.

    start counts the ids of all documents before it. Only one count per part, that is per
    task that wrote, comes to the driver.
    """
    spark = shards.sparkSession
    starts, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast(starts)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                ids = memoryview(WaveletMatrix.load(r["matrix"]).decode().astype("<u4").tobytes())
                ends = np.array(r["ends"], np.int64)
                begins = np.append(0, ends[:-1])
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), r["ends"])]
                yield batch_of(schema, r["doc_ids"], begins + r["before"] + shared.value[r["part"]], ends - begins, crc)

    return map_arrow(shards, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_places(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place in the document) of every occurrence, found by the planes alone."""
    schema = pa.schema([("token", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def find(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                matrix, ends = WaveletMatrix.load(r["matrix"]), np.array(r["ends"], np.int64)
                for token in tokens:
                    at = matrix.places(token)
                    doc = np.searchsorted(ends, at, side="right")
                    yield batch_of(schema, [token] * len(at), [r["doc_ids"][d] for d in doc], at - np.append(0, ends)[doc])

    return map_arrow(shards, find, "token int, doc_id long, place long")


def token_digest(docs: DataFrame, spec: str) -> DataFrame:
    """Write all documents' ids as wavelet matrices, read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only. Null doc_ids come first. Repeated rows
    keep a row each. An empty table gives no rows. Other columns are not read.
    """
    return read_documents(write_shards(docs, spec))

"""Helpers the operators of this folder share: Arrow maps, row numbers, components, token caches."""

from __future__ import annotations

import ctypes
import gc
import itertools
import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.core import materialize, ship_package

Batches = Iterator[pa.RecordBatch]

#: Bytes of a batch of whole texts on its way to an encoder: executor and worker hold it several times over.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _c_library():
    """The C library, if it is one that can be told when to give memory back."""
    try:
        library = ctypes.CDLL(None)
        return library if hasattr(library, "mallopt") and hasattr(library, "malloc_trim") else None
    except OSError:
        return None


def lean(batches: Batches) -> Batches:
    """The batches of a task. Workers outlive tasks: large blocks are mapped and go back when they are freed, the rest at the end."""
    library = _c_library()
    if library is not None:
        library.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD: else it rises with the blocks seen, and they stay with the worker
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if library is not None:
        library.malloc_trim(0)


def map_arrow(df: DataFrame, task: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """mapInArrow with this package on the workers, for any column names."""
    ship_package(df.sparkSession)
    names = df.columns

    def named(batches: Batches) -> Batches:
        yield from lean(task(b.rename_columns(names) for b in batches))

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, schema)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Jobs run inside send batches of about that many bytes to Python; the session's own bound is back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def utf8_size(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long) links: rows (node, label), label the smallest node.

    Nodes without a link to another node do not appear. Alternates the two star
    steps until nothing changes. The links of one node meet in one task, as (node,
    node) numbers: the join with the minimum per node is not split (see README).
    Each round is written to the shared folder, so lineage stays short.
    """
    links = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        links = materialize(small.where("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("b").alias("node"), F.col("a").alias("label"))
        state = now


#: Texts are encoded in slices of about this many bytes (one text at least), which bounds what a task holds.
SLICE_BYTES = 4_000_000

#: UTF-8 forms of the white space beyond ASCII: the first byte, and what follows it.
_WIDE_SPACES = {
    0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE3: [b"\x80\x80"],
    0xE2: [b"\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\x81\x9f"],
}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space, as the tokenizers' \\s has it."""
    out = _SPACE[data]
    for lead, tails in _WIDE_SPACES.items():
        at = np.flatnonzero(data == lead)
        for tail in tails:
            own = at[at + len(tail) < len(data)]
            for k, byte in enumerate(tail, 1):
                own = own[data[own + k] == byte]
            for k in range(len(tail) + 1):
                out[own + k] = True
    return out


def in_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about that many bytes of text."""
    taken = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    border = np.flatnonzero(np.diff(taken // size)) + 1 if len(taken) else []
    for a, b in zip([0, *border], [*border, batch.num_rows]):
        if a < b:
            yield batch.slice(a, b - a)


#: Latin letters whose small form does not depend on what stands around them.
_PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"


def spread_places(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places at, at + 1, .. of runs of the given sizes, one run after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(at - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)


class WordTokenizer:
    """Token ids of many whole texts at once, encoding each different word once.

    Both vocabularies part a text between a word and the white space after it before any
    merge, so the ids of a text are those of its units in turn: a run of white space and the word behind
    it. Units are found in the bytes and numbered by Arrow's dictionary encoding; only
    different ones reach the tokenizer. Plain ones (Latin letters, perhaps with marks behind them) are
    encoded in lines of many, parted again at the pieces that mark a border.
    Ids are 16-bit. From call to call the ids of at most KEEP plain words are kept, in flat
    arrays of about 30 bytes a word; each call holds a hash table over them beside.
    """

    TOGETHER = 200
    KEEP = 300_000
    shared: dict[int, "WordTokenizer"] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        border = (lambda p: p.endswith(self.suffix)) if self.suffix else (lambda p: p.startswith("Ġ"))
        self.border = np.zeros(1 << 16, bool)
        self.border[[i for p, i in vocabulary.items() if border(p)]] = True
        # a plain word: letters behind one space (behind any white space where the vocabulary drops it), then marks
        # that stand for themselves; an apostrophe does not, it may join the letters behind it
        lead = "[ \\n\\t]*(?P<core>" if self.suffix else "(?P<core> "
        self.plain = f"^{lead}[{_PLAIN}]+)(?P<tail>[!-&(-/:-@\\[-`{{-~]*)$"
        self.known, self.ids, self.at, self.length = self._nothing()

    @classmethod
    def of(cls, spec: str) -> "WordTokenizer":
        """The worker's own instance: the vocabulary is read once."""
        key = hash(spec)
        if key not in cls.shared:
            cls.shared[key] = cls(spec)
        return cls.shared[key]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one by one, and how many each has."""
        ids, sizes = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        for start in range(0, len(texts), 20_000):
            some = self._ids(texts[start : start + 20_000])
            sizes.append(np.fromiter(map(len, some), np.int64, len(some)))
            ids.append(np.fromiter(itertools.chain.from_iterable(some), np.uint16, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _each, for plain words: each has one border piece."""
        lines = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        ids, sizes = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        between = " " if self.suffix else ""  # else words bring their space
        for start in range(0, len(lines), 50):
            some = lines[start : start + 50]
            for line, own in zip(some, self._ids([between.join(line) for line in some])):
                own = np.array(own, np.uint16)
                found = np.flatnonzero(self.border[own])
                ends = found + 1 if self.suffix else np.append(found[1:], len(own))
                if len(found) != len(line):  # a border where none was expected
                    own, each = self._each(line)
                else:
                    each = np.diff(ends, prepend=0)
                ids.append(own)
                sizes.append(each)
        return np.concatenate(ids), np.concatenate(sizes)

    def _cores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of different plain words, where those of each begin, and how many they are."""
        place = pa.compute.fill_null(pa.compute.index_in(words, value_set=self.known), -1).to_numpy().copy()
        new = place < 0
        fresh = words.filter(pa.array(new))
        ids, sizes = self._lines(fresh.to_pylist())
        at = np.append(self.at, len(self.ids) + np.cumsum(sizes) - sizes)
        length = np.append(self.length, sizes)
        all_ids = np.concatenate([self.ids, ids])
        place[new] = len(self.known) + np.arange(len(fresh))
        self.known, self.ids, self.at, self.length = pa.concat_arrays([self.known, fresh]), all_ids, at, length
        if len(self.known) > self.KEEP:
            self.known, self.ids, self.at, self.length = self._nothing()
        return all_ids, at[place], length[place]

    @staticmethod
    def _nothing():
        return pa.array([], pa.string()), np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)

    def _distinct(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different units, and where those of each begin and how many they are."""
        parts = pa.compute.extract_regex(units, self.plain)
        plain = parts.is_valid()
        parts = parts.filter(plain)
        cores, tails = parts.field("core"), parts.field("tail").dictionary_encode()
        coded = (pa.compute.utf8_lower(cores) if self.suffix else cores).dictionary_encode()
        core_ids, core_at, core_sizes = self._cores(coded.dictionary)
        tail_ids, tail_sizes = self._each(tails.dictionary.to_pylist())
        core, tail = coded.indices.to_numpy(), tails.indices.to_numpy()
        first, second = core_sizes[core], tail_sizes[tail]
        sizes = first + second
        begin = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.uint16)
        ids[spread_places(begin, first)] = core_ids[spread_places(core_at[core], first)]
        ids[spread_places(begin + first, second)] = tail_ids[spread_places((np.cumsum(tail_sizes) - tail_sizes)[tail], second)]
        other_ids, other_sizes = self._each(units.filter(pa.compute.invert(plain)).to_pylist())
        plain = plain.to_numpy(zero_copy_only=False)
        at, length = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        at[plain], length[plain] = begin, sizes
        at[~plain], length[~plain] = len(ids) + np.cumsum(other_sizes) - other_sizes, other_sizes
        return np.concatenate([ids, other_ids]), at, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each text end; none for null."""
        texts = pa.compute.fill_null(texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        size = int(offsets[-1] - offsets[0])
        if not size:
            return np.empty(0, np.uint16), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[0] + size]
        offsets = offsets - offsets[0]
        space = spaces(data)
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(first)
        ends = np.append(begin, size).astype(np.int32)
        units = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data))
        coded = units.dictionary_encode()
        ids, at, length = self._distinct(coded.dictionary)
        code = coded.indices.to_numpy()
        much = np.cumsum(length[code])
        out = np.empty(int(much[-1]), np.uint16)
        for k in range(0, len(code), 250_000):  # bounds the index arrays
            some, upto = code[k : k + 250_000], much[k : k + 250_000]
            each = length[some]
            start = int(upto[0] - each[0])
            out[start : int(upto[-1])] = ids[np.repeat(at[some] - (upto - each - start), each) + np.arange(int(upto[-1]) - start)]
        return out, np.append(0, much)[np.searchsorted(begin, offsets[1:])]


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def plain(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

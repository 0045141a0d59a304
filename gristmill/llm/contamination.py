"""Positional inverted index of training texts, and phrase or proximity search of benchmark items in it."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm.common import Batches, batch_of, map_arrow, task_number, text_bytes

WINDOW = 10
#: Words of a block: the unit that holds its own postings. A longer text is a block alone.
BLOCK_WORDS = 1_000_000
#: Words of the windows that are searched at once; more items are searched in further rounds.
ROUND_WORDS = 2_000_000
#: Bytes of them likewise: what is sent to all tasks at once.
ROUND_BYTES = 32_000_000
#: Places a word may be off in a proximity match; GAP holds for up to three.
NEAR = 2
#: Free places between documents: more than two words that follow one another can be apart in a match.
GAP = 8

#: Fixed rule: A-Z become a-z, and every ASCII character but 0-9 a-z parts words.
_WORDS = bytes(c if c > 127 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


INDEX = "block long, term string, positions array<int>, doc_ids array<bigint>"
_INDEX = pa.schema([("block", pa.int64()), ("term", pa.string()), ("positions", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])


def _post(batches: Batches) -> Batches:
    """Postings of one block after the other.

    A block has a row for each of its words, with the ascending places, and one row
    without a word: its doc_ids, and the place behind each document's last word. Between
    documents some places stay free, so no match runs over an end.
    """
    count = 0
    numbers, tokens, ends, ids, place = _Numbers(), [], [], [], 0

    def block() -> pa.RecordBatch:
        flat = np.concatenate([t for t, _ in tokens]) if tokens else np.empty(0, np.int32)
        places = np.concatenate([np.arange(at, at + len(t), dtype=np.int32) for t, at in tokens]) if tokens else flat
        order = np.argsort(flat, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(numbers)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, offsets[-1] + len(ends)).astype(np.int32)), pa.array(np.concatenate([places[order], np.array(ends, np.int32)])))
        n = len(numbers)
        terms = pa.array([*numbers, None], pa.binary()).cast(pa.string())
        owners = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1, np.int32), len(ids)).astype(np.int32)), pa.array(ids, pa.int64()))
        return batch_of(_INDEX, np.full(n + 1, (task_number() << 32) + count), terms, lists, owners)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
            w = words(text)
            if w:
                tokens.append((np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)), place))
            ends.append(place + len(w))
            ids.append(doc_id)
            place += len(w) + GAP
            if place >= BLOCK_WORDS:
                yield block()
                count += 1
                numbers, tokens, ends, ids, place = _Numbers(), [], [], [], 0
    if ids:
        yield block()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text): written once to the shared folder, for any number of searches."""
    return materialize(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _post, INDEX), "postings")


def _windows(batches: Batches) -> Batches:
    schema = pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.string()))])
    for batch in batches:
        yield batch_of(schema, batch.column("item_id"), [[x.decode() for x in words(t)] for t in text_bytes(batch.column("text"))])


MATCHES = "block long, ord int, item_id string, lo int, hi int, exact boolean"


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches that windows of one length cover."""
    starts = np.unique(starts)
    new = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(part[0]), int(part[-1]) + length) for part in np.split(starts, new) if len(part)]


def _search(shared, near: int):
    """Function of a block's postings; shared is a broadcast of the items (item_id, words)."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        postings = {t: p for t, p in zip(frame["term"], frame["positions"]) if t is not None}
        ends = np.asarray(frame.loc[frame["term"].isna(), "positions"].iloc[0])
        found = defaultdict(list)
        for item, terms in shared.value:
            length = min(WINDOW, len(terms))
            sizes = [len(postings.get(t, ())) for t in terms]
            for first in range(len(terms) - length + 1):
                part = sizes[first : first + length]
                if 0 in part:
                    continue
                rarest, *others = sorted(range(length), key=part.__getitem__)
                starts = np.asarray(postings[terms[first + rarest]]) - rarest
                off = np.zeros(len(starts), int)
                for k in others:
                    places = np.asarray(postings[terms[first + k]]) - k
                    at = np.searchsorted(places, starts)
                    gap = np.minimum(np.abs(places[np.minimum(at, len(places) - 1)] - starts), np.abs(places[np.maximum(at - 1, 0)] - starts))
                    starts, off = starts[gap <= near], np.maximum(off, gap)[gap <= near]
                    if not len(starts):
                        break
                if len(starts):
                    docs = np.searchsorted(ends, starts + rarest, side="right")
                    for exact in (True, False):
                        keep = (off == 0) == exact
                        for d in np.unique(docs[keep]):
                            found[int(d), item, length, exact].append(starts[keep & (docs == d)])
        rows = [
            (int(frame["block"].iloc[0]), d, item, lo, hi, exact)
            for (d, item, length, exact), starts in found.items() for lo, hi in _spans(np.concatenate(starts), length)
        ]
        return pd.DataFrame(rows, columns=["block", "ord", "item_id", "lo", "hi", "exact"])

    return block


def find_items(index: DataFrame, items: DataFrame, near: int = NEAR) -> DataFrame:
    """Occurrences of the items' windows: (block, ord, item_id, lo, hi, exact).

    ord is the document's number in its block; lo and hi bound the words that touching
    windows of the item cover there. Each window starts from the places of its rarest
    word in the block; the places of the next rarer words, less their offsets, are
    intersected one after the other. exact: every word stands in its place; otherwise it
    is a proximity match, with words up to near places off, lo and hi as its rarest word
    puts them.

    Items are searched in rounds of bounded size, so what is sent to the tasks has a
    fixed bound however large the benchmark is.
    """
    if 2 * near + 1 > GAP:
        raise ValueError("near is wider than the gap between documents allows")
    spark = index.sparkSession
    parted = materialize(
        map_arrow(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), _windows, "item_id string, words array<string>").where("size(words) > 0").distinct(),
        "items",
    )
    size = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w))
    total, held = (x or 0 for x in parted.agg(F.sum(F.size("words")), F.sum(size)).first())
    rounds = max(-(-total // ROUND_WORDS), -(-held // ROUND_BYTES))
    out = None
    for k in range(rounds):
        some = parted.where(F.pmod(F.xxhash64("words"), F.lit(rounds)) == k) if rounds > 1 else parted
        terms = some.select(F.explode("words").alias("term")).distinct()
        # no more than a round's words, so no common word's postings meet in one task
        postings = index.join(F.broadcast(terms), "term", "left_semi").select("block", "term", "positions").unionByName(
            index.where("term is null").select("block", "term", "positions")
        )
        asked = spark.sparkContext.broadcast([(r["item_id"], r["words"]) for r in some.collect()])
        found = postings.groupBy("block").applyInPandas(_search(asked, near), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def contamination(docs: DataFrame, items: DataFrame, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items.

    n_hit counts words inside exact occurrences of any item's window (ten words, or all
    of a shorter item); n_near counts items with a proximity match only. Null or empty
    text: no words, not contaminated. Null, empty or wordless items never match. Items
    that share an id count once; a null item id hits, but is not listed. Repeated and null
    doc_ids keep a row each. Empty tables: no rows, or no hits. Other columns are not read.
    """
    index = build_index(docs)
    found = materialize(find_items(index, items, near), "matches")
    fold = """aggregate(array_sort(spans), named_struct('upto', 0, 'words', 0L),
        (a, s) -> named_struct('upto', greatest(a.upto, s.hi), 'words', a.words + greatest(0, s.hi - greatest(a.upto, s.lo))), a -> a.words)"""
    hits = found.where("exact").groupBy("block", "ord").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    ).select("block", "ord", F.expr(fold).alias("n_hit"), "items")
    close = found.groupBy("block", "ord", "item_id").agg(F.bool_or("exact").alias("exact")).groupBy("block", "ord").agg(F.count_if(~F.col("exact")).alias("n_near"))
    rows = index.where("term is null").select("block", F.posexplode(F.arrays_zip("doc_ids", "positions", F.expr(f"concat(array(-{GAP}), slice(positions, 1, size(positions) - 1))").alias("last"))).alias("ord", "d"))
    rows = rows.select("block", "ord", F.col("d.doc_ids").alias("doc_id"), (F.col("d.positions") - F.col("d.last") - GAP).cast("long").alias("n_words"))
    out = rows.join(hits, ["block", "ord"], "left").join(close, ["block", "ord"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), listed.alias("items"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold an item's window; all columns, clean documents untouched.

    Rows are told apart by id and text, so a clean row is never dropped for another of its id.
    """
    keyed = docs.select("doc_id", "text")
    index_of = contamination(keyed.withColumn("doc_id", F.xxhash64("doc_id", "text")), items).where("contaminated").select(F.col("doc_id").alias("hit_key")).distinct()
    return docs.join(index_of, F.xxhash64("doc_id", "text") == F.col("hit_key"), "left_anti").select(*docs.columns)

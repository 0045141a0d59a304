"""Packing of token pieces into sequences: linear grouping, configurations, then best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.core import broadcast_if_small, materialize
from gristmill.llm.common import Batches, WordTokenizer, batch_of, in_slices, map_arrow, small_batches, task_number

CAPACITY = 2048
END = 0
#: Lengths above this share of a sequence are large: grouped and configured, the others fill gaps.
LARGE = 1 / 8
GROUPS = 64
#: Configurations tried for each group before the best so far are used.
STEPS = 8
#: Configurations that leave more than this free are tried with and without: best fit may do better there.
WASTE = (CAPACITY, 16)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def token_pieces(docs: DataFrame, spec: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids, written once, numbered per task and length (part, place).

    spec is the tokenizer's description as text. with_ids adds the ids themselves as
    little-endian unsigned 16-bit integers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES

    def encode(batches: Batches) -> Batches:
        tokenizer, part, places = WordTokenizer.of(shared.value), task_number(), defaultdict(int)
        for batch in batches:
            for some in in_slices(batch):
                ids, upto = tokenizer.encode(some.column("text"))
                upto = upto.tolist()
                whole = np.insert(ids, upto, np.uint16(END))  # an end behind each document
                data, rows, at = memoryview(whole.astype("<u4")).cast("B"), [], 0
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), [0, *upto], upto):
                    for k, (start, n) in enumerate(cut(b - a + 1, capacity)):
                        row = (doc_id, k, start, n, zlib.crc32(data[4 * at : 4 * (at + n)]), part, places[n])
                        rows.append((*row, whole[at : at + n].tobytes()) if with_ids else row)
                        places[n] += 1
                        at += n
                yield batch_of(schema, *zip(*rows))

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        return materialize(map_arrow(asked, encode, PIECES + (", ids binary" if with_ids else "")), "pieces")


def fullest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: its worth, and how often it holds each size (any number of times)."""
    room = np.arange(capacity + 1)[:, None] - sizes
    rest = np.maximum(room, 0)
    best, choices = np.zeros(capacity + 1), []
    while len(choices) < capacity // sizes.min():
        more = np.where(room >= 0, best[rest] + worth, 0.0)
        choice = more.argmax(axis=1)
        value = more[np.arange(capacity + 1), choice]
        better = value > best + 1e-12
        if not better.any():
            break
        choices.append(np.where(better, choice, -1))
        best = np.where(better, value, best)
    held, left = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[left] >= 0:
            held[choice[left]] += 1
            left -= sizes[choice[left]]
    return float(held @ worth), held


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often to use each: the fewest sequences that hold the sizes, in fractions.

    The linear program over all configurations, solved by column generation: the prices of the
    sizes under the present configurations name the one of most worth, which enters in
    place of the first that runs out, until none is worth more than a sequence.
    """
    size, demand = np.array(sizes), np.array(demand, float)
    columns = np.diag((capacity // size).astype(float))
    for _ in range(steps):
        worth, held = fullest(size, np.linalg.solve(columns.T, np.ones(len(size))), capacity)
        if worth <= 1 + 1e-9:
            break
        times, change = np.linalg.solve(columns, demand), np.linalg.solve(columns, held)
        ratio = np.where(change > 1e-9, np.maximum(times, 0) / np.maximum(change, 1e-9), np.inf)
        columns[:, int(ratio.argmin())] = held
    return columns, np.linalg.solve(columns, demand)


class Plan:
    """Where the k-th item of each length goes, made from the number of items of each length alone.

    Large lengths are rounded up in groups of equal cardinality; the configuration program
    over the few rounded sizes is solved, its numbers of uses are rounded down, and actual
    items take the slots. What is left, large and small, goes by falling length into the
    sequence with the least room that holds it. That is done with all configurations, with
    those that leave little free, and with none; the plan of the fewest sequences is taken, so
    rounding never costs more than the configurations give.

    The work and the size of the plan depend on the capacity, not on the number of
    items: runs of sequences that look alike are handled as one. events: (length, lo,
    hi, sequence, offset) puts items lo <= k < hi of that length at offset in the
    sequences from the given one on.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity = capacity
        items = [(n, 0, c) for n, c in sorted(counts.items(), reverse=True) if c]
        large, small = [i for i in items if i[0] > capacity * LARGE], [i for i in items if i[0] <= capacity * LARGE]
        sized = self.grouped(large, groups)
        uses = [] if not sized else list(zip(*(x.T.astype(int if k == 0 else float).tolist() for k, x in enumerate(
            configurations([g["size"] for g in sized], [g["left"] for g in sized], capacity, STEPS * len(sized))))))
        plans = [self.filled(items)]
        for waste in WASTE if uses else ():
            close = [(held, times) for held, times in uses if capacity - sum(k * g["size"] for k, g in zip(held, sized)) <= waste]
            plans.append(self.filled(small, self.grouped(large, groups), close))
        best = min(range(len(plans)), key=lambda k: (plans[k][1], k == 0))
        self.configured = best > 0
        self.events, self.sequences = plans[best]

    def filled(self, items: list[tuple[int, int, int]], groups: list[dict] = (), uses: list[tuple] = ()) -> tuple[list[tuple], int]:
        """Events and number of sequences: the configurations, then what they leave of the groups and the items by best fit."""
        self.events, self.sequences = [], 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (first, number)
        self.free = 0  # bit r: sequences with r free tokens exist
        for held, times in sorted(uses, reverse=True):
            used = [(g, k) for g, k in zip(groups, held) if k]
            times = min(int(times + 1e-6), *(g["left"] // k for g, k in used))
            if times > 0:
                self.lay([self.take(g, times) for g, k in used for _ in range(k)], times)
        items = items + [run for g in groups for run in g["runs"]]
        for n, lo, hi in sorted(items, key=lambda run: (-run[0], run[1])):
            self.best_fit(n, lo, hi)
        return self.events, self.sequences

    @staticmethod
    def grouped(large: list[tuple[int, int, int]], groups: int) -> list[dict]:
        """Linear grouping: groups of equal cardinality by falling length, each rounded up to its longest; equal sizes are one."""
        total = sum(hi - lo for _, lo, hi in large)
        each = max(1, -(-total // groups))
        out: list[dict] = []
        for n, lo, hi in large:
            while lo < hi:
                if not out or out[-1]["left"] == each:
                    out.append({"size": n, "runs": [], "left": 0})
                take = min(hi - lo, each - out[-1]["left"])
                out[-1]["runs"].append((n, lo, lo + take))
                out[-1]["left"] += take
                lo += take
        merged: dict[int, dict] = {}
        for g in out:
            same = merged.setdefault(g["size"], {"size": g["size"], "runs": [], "left": 0})
            same["runs"] += g["runs"]
            same["left"] += g["left"]
        return list(merged.values())

    @staticmethod
    def take(group: dict, times: int) -> list[tuple[int, int, int]]:
        """The group's next actual items, as runs of one length."""
        out = []
        group["left"] -= times
        while times:
            n, lo, hi = group["runs"].pop(0)
            k = min(times, hi - lo)
            out.append((n, lo, lo + k))
            times -= k
            if lo + k < hi:
                group["runs"].insert(0, (n, lo + k, hi))
        return out

    def lay(self, slots: list[list[tuple[int, int, int]]], times: int) -> None:
        """New sequences with one item of each slot; a run has the same lengths all over."""
        at = [0] * len(slots)
        slots = [list(s) for s in slots]
        done = 0
        while done < times:
            k = min(slot[i][2] - slot[i][1] for slot, i in zip(slots, at))
            offset = 0
            for j, (slot, i) in enumerate(zip(slots, at)):
                n, lo, hi = slot[i]
                self.events.append((n, lo, lo + k, self.sequences, offset))
                offset += n
                slot[i] = (n, lo + k, hi)
                at[j] += lo + k == hi
            self.leave(self.capacity - offset, self.sequences, k)
            self.sequences += k
            done += k

    def leave(self, free: int, first: int, number: int) -> None:
        if free:
            self.open[free].append((first, number))
            self.free |= 1 << free

    def best_fit(self, n: int, lo: int, hi: int) -> None:
        """Items of one length, each into the sequence with the least room that holds it."""
        while lo < hi and (fitting := self.free >> n):
            free = n + (fitting & -fitting).bit_length() - 1
            first, number = self.open[free].pop()
            k = min(number, hi - lo)
            if k < number:
                self.open[free].append((first + k, number - k))
            elif not self.open[free]:
                self.free &= ~(1 << free)
            self.events.append((n, lo, lo + k, first, self.capacity - free))
            self.leave(free - n, first, k)
            lo += k
        each = self.capacity // n
        for per, number in ((each, (hi - lo) // each), ((hi - lo) % each, 1)):
            if per and number:
                for j in range(per):
                    self.events.append((n, lo, lo + number, self.sequences, j * n))
                    lo += number
                self.leave(self.capacity - per * n, self.sequences, number)
                self.sequences += number


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length, part, place and any more) with sequence_id and offset (long).

    The driver gets one count for each length, at most capacity of them, and sends back
    the plan, whose size is bounded by the capacity too. Each piece finds its rank among
    those of its length from its place in its part and the parts' counts, so no task
    sees all pieces of a common length. Every piece is placed once; offsets are gapless
    from 0. An empty table gives no rows.
    """
    per_part = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if counts and max(counts) > capacity:
        raise ValueError("a piece is longer than a sequence")
    plan = Plan(counts, capacity)
    columns = ("of", "lo", "hi", "first", "offset")
    events = pieces.sparkSession.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*plan.events)] or [pa.array([], pa.int64())] * 5, names=columns))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    at = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(broadcast_if_small(events), at)  # bounded by the capacity, not by the rows
    return placed.select(*pieces.columns, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, spec: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text and the end id 0; null and empty texts
    have the end id only. Only documents longer than a sequence are cut. Null and
    repeated doc_ids keep all their pieces. Other columns are not read. with_ids adds
    the ids (see token_pieces), from which `sequences` writes whole sequences.
    """
    packed = pack(token_pieces(docs, spec, capacity, with_ids), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids; a sequence holds at most the capacity."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.expr("aggregate(transform(array_sort(collect_list(struct(offset, ids))), p -> p.ids), X'', (a, i) -> concat(a, i))").alias("ids"),
    )

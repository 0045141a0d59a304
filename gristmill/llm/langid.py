"""Language of a text by unigram piece models, summed over all segmentations."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.core import bounded_values, materialize
from gristmill.llm.common import Batches, batch_of, map_arrow

UNKNOWN = "und"
#: Training reads about this many documents of each language (all, if fewer): the bound of the sample.
DOCUMENTS_PER_LANGUAGE = 1_500
#: More labels than this are an error: driver and tasks hold a column of piece chances for each
#: (a quarter of a megabyte for 32,000 pieces).
MOST_LANGUAGES = 1_000
EM_ROUNDS = 4
#: Words are scored in parts of at most this many characters, so no product underflows.
PART = 32
FLOOR = 1e-8
#: Word parts that are split into pieces together.
TOGETHER = 4_000
#: Bytes of word scores a task keeps.
KEPT_BYTES = 48_000_000
LETTERS = re.compile(r"[^\W\d_]+").findall
WORD_MARK = "▁"  # what the vocabulary writes for the start of a word
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The fixed vocabulary, looked up by polynomial hashes of character codes."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p and len(p) <= PART})
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.array([self.hash(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if len(np.unique(self.sorted)) != len(self.sorted):
            raise ValueError("two pieces share a hash")

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def cells(self, words: list[str]):
        """Of words sorted by falling length: for each end and piece length, (number of words, piece ids).

        The id after the last stands for a single character outside the vocabulary, -1 for no piece.
        """
        lengths = np.array([len(w) for w in words])
        codes = np.zeros((len(words), lengths.max()), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat + np.uint64(1)
        prefix = np.zeros((len(words), codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i]
        powers = np.cumprod(np.full(self.longest + 1, _BASE)) if self.longest else []
        out = []
        for end in range(1, codes.shape[1] + 1):
            n = int(np.searchsorted(-lengths, -end, side="right"))
            row = []
            for size in range(1, min(end, self.longest) + 1):
                h = prefix[:n, end] - prefix[:n, end - size] * powers[size - 1]
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                ids = np.where(self.sorted[at] == h, self.order[at], len(self.pieces) if size == 1 else -1).astype(np.int32)
                row.append(ids)
            out.append((n, row))
        return lengths, out


def forward(cells, chances: np.ndarray) -> list[np.ndarray]:
    """Per end: summed chance of all segmentations of the word up to there, words x languages."""
    lengths, ends = cells
    sums = [np.ones((len(lengths), chances.shape[1]))]
    for end, (n, row) in enumerate(ends, 1):
        total = np.zeros((n, chances.shape[1]))
        for size, ids in enumerate(row, 1):
            some = np.flatnonzero(ids >= 0)
            total[some] += sums[end - size][some] * chances[ids[some]]
        sums.append(total)
    return sums


def expected_counts(cells, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece in weighted words (words x languages), over all segmentations."""
    lengths, ends = cells
    sums = forward(cells, chances)
    back = [np.zeros((len(lengths), chances.shape[1])) for _ in range(len(ends) + 1)]
    whole = np.zeros((len(lengths), chances.shape[1]))
    for end in range(len(ends) + 1):
        here = np.flatnonzero(lengths == end)
        if len(here):
            back[end][here] = 1.0
            whole[here] = sums[end][here]
    counts = np.zeros_like(chances)
    share = weights / np.maximum(whole, 1e-300)
    for end in range(len(ends), 0, -1):
        _, row = ends[end - 1]
        for size, ids in enumerate(row, 1):
            some = np.flatnonzero(ids >= 0)
            step = chances[ids[some]] * back[end][some]
            back[end - size][some] += step
            np.add.at(counts, ids[some], sums[end - size][some] * step * share[some])
    return counts


def parts_of(word: str) -> list[str]:
    marked = WORD_MARK + word
    return [marked[i : i + PART] for i in range(0, len(marked), PART)]


def vocabulary(path: str) -> list[str]:
    """Text pieces of a public sentence-piece model; control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _count_words(batches: Batches) -> Batches:
    from collections import Counter

    schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("n", pa.int64())])
    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            seen.update((lang, p) for w in LETTERS(text.lower()) for p in parts_of(w))
        yield batch_of(schema, [k[0] for k in seen], [k[1] for k in seen], list(seen.values()))


def train(labelled: DataFrame, pieces: list[str], per_language: int = DOCUMENTS_PER_LANGUAGE, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and chance of each piece (rows; the last row: any other character) in each.

    Every language with a labelled text is learned, however rare; more than MOST_LANGUAGES
    are an error. Reads about per_language different texts of each language (all, if fewer),
    picked by a hash of the text, so copies neither count nor thin the sample. Word counts stay distributed; each round of expectation and
    maximisation adds up expected piece counts in the tasks, and only the table of
    pieces by languages comes to the driver.
    """
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang")
    different = labelled.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in bounded_values(different, "languages", MOST_LANGUAGES)}
    langs = sorted(sizes)
    if not langs:
        return [], np.empty((0, 0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "text"])
    counted = map_arrow(sample, _count_words, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "words")

    chances = np.full((len(set(p for p in pieces if p and len(p) <= PART)) + 1, len(langs)), 1.0)
    shared, number = labelled.sparkSession.sparkContext.broadcast(pieces), {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):
        chances /= chances.sum(axis=0)
        chances = np.maximum(chances, FLOOR)
        now = labelled.sparkSession.sparkContext.broadcast(chances)

        def expect(batches: Batches, now=now) -> Batches:
            known, schema = Pieces(shared.value), pa.schema([("piece", pa.int32()), ("lang", pa.int32()), ("n", pa.float64())])
            counts = np.zeros_like(now.value)
            for batch in batches:
                rows = sorted(zip(batch.column("part").to_pylist(), batch.column("lang").to_pylist(), batch.column("n").to_pylist()), key=lambda r: -len(r[0]))
                for start in range(0, len(rows), TOGETHER):
                    some = rows[start : start + TOGETHER]
                    weights = np.zeros((len(some), len(langs)))
                    weights[np.arange(len(some)), [number[r[1]] for r in some]] = [r[2] for r in some]
                    counts += expected_counts(known.cells([r[0] for r in some]), now.value, weights)
            piece, lang = np.nonzero(counts)
            yield batch_of(schema, piece.astype(np.int32), lang.astype(np.int32), counts[piece, lang])

        summed = map_arrow(counted, expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        chances = np.full(chances.shape, 0.01)
        np.add.at(chances, (summed["piece"].to_numpy(), summed["lang"].to_numpy()), summed["n"].to_numpy())
        now.destroy()  # this round's counts are here
    shared.destroy()
    chances /= chances.sum(axis=0)
    return langs, np.maximum(chances, FLOOR)


class WordScores(dict):
    """Log chances of lower-case words, a row of numbers each; emptied when large."""

    def __init__(self, pieces: Pieces, chances: np.ndarray):
        self.pieces, self.chances = pieces, chances
        self.keep = max(1, KEPT_BYTES // (200 + 8 * chances.shape[1]))  # a word and its entry take about 200 bytes
        self.rows = np.empty((1024, chances.shape[1]))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.keep:
            self.clear()
            self.rows = np.empty((1024, self.chances.shape[1]))
            new = list(words)
        parts = sorted({p for w in new for p in parts_of(w)}, key=len, reverse=True)
        if not parts:
            return
        logs = {}
        for start in range(0, len(parts), TOGETHER):
            some = parts[start : start + TOGETHER]
            cells = self.pieces.cells(some)
            sums = forward(cells, self.chances)
            for i, (w, n) in enumerate(zip(some, cells[0])):
                logs[w] = sums[n][i]
        while len(self) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        for w in new:
            first, *rest = parts_of(w)
            row = np.log(logs[first])
            for p in rest:
                row = row + np.log(logs[p])
            self.rows[len(self)] = row
            self[w] = len(self)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], pieces: list[str]) -> DataFrame:
    """docs with lang_pred and score added: the likeliest language and its posterior under equal priors.

    Every word of the whole text counts. Null text, text without letters, or a model
    without languages: `und`, score 0. Ties go to the first language in order of name.
    Input columns named lang_pred or score are replaced.
    """
    langs, chances = model
    context = docs.sparkSession.sparkContext
    shared, table = context.broadcast(pieces), context.broadcast(chances)
    docs = docs.drop("lang_pred", "score")
    fields = [*docs.schema.fields]

    def score(batches: Batches) -> Batches:
        scores = WordScores(Pieces(shared.value), table.value) if langs else None
        for batch in batches:
            named, value = [], []
            texts = batch.column("text")
            for start in range(0, len(texts), 200):
                spelled = [LETTERS(t.lower()) if t else [] for t in texts.slice(start, 200).to_pylist()]
                if scores is not None:
                    scores.learn({w for words in spelled for w in words})
                for words in spelled:
                    if scores is None or not any(c.isalpha() for w in words for c in w):
                        named.append(UNKNOWN)
                        value.append(0.0)
                        continue
                    total = scores.rows[np.fromiter(map(scores.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    named.append(langs[best])
                    value.append(float(1 / np.exp(total - total[best]).sum()))
            columns = [*batch.columns, pa.array(named, pa.string()), pa.array(value, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    from gristmill.llm.common import plain

    return map_arrow(docs, score, plain(docs.schema) + ", lang_pred string, score double" if fields else "lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows models may learn from: the crc32 of their doc_id's text leaves no 1 when divided by 3."""
    return docs.where(fold(F.col("doc_id")) != 1)


def fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3

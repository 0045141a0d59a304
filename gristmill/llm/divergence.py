"""How the sources of a language differ in their words: equal texts are collapsed and split into words once."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm.common import Batches, batch_of, map_arrow, text_bytes

#: Terms in fewer documents of a language are not kept.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: A text that makes up one in so many documents comes from one of its rows only; there are at most this many such texts.
FREQUENT = 4_096
#: Entries a task holds before it passes them on.
HELD = 200_000

#: Only A-Z is lower-cased; all other ASCII characters part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents and occurrences are added up as one number; a task passes on far fewer occurrences than this.
_DOCUMENT = 1 << 48

_COLLAPSED = pa.schema([
    ("lang", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()),
    ("sources", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("text", pa.string()),
])
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def collapse(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of equal texts of a language by digest: (lang, h1, h2, sources, copies, text).

    A task sends a text once, with the number of its copies per source; later copies are
    numbers only. Texts that make up a large share of the documents (at most FREQUENT of
    them, since their shares add up to one) are sent by the rows with their smallest id
    alone, so that no text arrives once from every task.
    """
    named = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")],
        F.col(id_column).cast("string").alias("id"),
    ).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(12), "text").alias("h2"))
    total = docs.count()
    often = named.groupBy("lang", "h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("id")).where((F.col("n") > 1) & (F.col("n") * FREQUENT >= total))
    elected = docs.sparkSession.sparkContext.broadcast({(r["lang"], r["h1"], r["h2"]): r["id"] for r in often.collect()})

    def task(batches: Batches) -> Batches:
        frequent, sent, held = elected.value, set(), {}

        def passed_on() -> pa.RecordBatch:
            keys, sources = list(held), list(held.values())
            held.clear()
            return batch_of(_COLLAPSED, *zip(*keys), [list(s) for s in sources], [list(s.values()) for s in sources], [None] * len(keys)) if keys else batch_of(_COLLAPSED, *[[]] * 6)

        for batch in batches:
            rows, texts = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "h1", "h2")))
            for i, (key, source, own) in enumerate(zip(keys, batch.column("source").to_pylist(), batch.column("id").to_pylist())):
                if key in sent or (key in frequent and frequent[key] != own):
                    copies = held.setdefault(key, {})
                    copies[source] = copies.get(source, 0) + 1
                else:
                    sent.add(key)
                    rows.append((*key, [source], [1]))
                    texts.append(i)
            if rows:
                yield batch_of(_COLLAPSED, *zip(*rows), batch.column("text").take(pa.array(texts)))
            if len(sent) > HELD:
                sent.clear()
            if len(held) > HELD:
                yield passed_on()
        yield passed_on()

    return map_arrow(named, task, "lang string, h1 long, h2 long, sources array<string>, copies array<long>, text string")


def _count_terms(batches: Batches) -> Batches:
    """From rows in order of their key, a text first: documents and occurrences per language, source and term."""
    held: dict[tuple, dict[bytes, int]] = {}
    entries = 0
    now, terms, copies = None, {}, Counter()

    def add() -> int:
        more = 0
        for source, times in copies.items():
            own = held.setdefault((now[0], source), {})
            more -= len(own)
            get = own.get
            for term, n in terms.items():
                own[term] = get(term, 0) + times * (_DOCUMENT + n)
            more += len(own)
        return more

    def passed_on():
        for (lang, source), own in held.items():
            values = list(own.values())
            yield batch_of(
                _COUNTS, [lang] * len(own), [source] * len(own), pa.array(list(own), pa.binary()).cast(pa.string()),
                [v // _DOCUMENT for v in values], [v % _DOCUMENT for v in values],
            )
        held.clear()

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "h1", "h2")))
        for key, sources, times, text in zip(keys, batch.column("sources").to_pylist(), batch.column("copies").to_pylist(), text_bytes(batch.column("text"))):
            if key != now:
                entries += add() if now else 0
                now, copies = key, Counter()
                terms = Counter(terms_of(text or b""))
                if entries > HELD:
                    yield from passed_on()
                    entries = 0
            for source, n in zip(sources, times):
                copies[source] += n
    if now:
        add()
    yield from passed_on()


def term_counts(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """lang, source, term, docs (documents with the term), n (occurrences), each different text split once."""
    rows = collapse(docs, id_column).repartition("lang", "h1", "h2").sortWithinPartitions("lang", "h1", "h2", F.col("text").isNull())
    counted = map_arrow(rows, _count_terms, "lang string, source string, term string, docs long, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(count: str, whole: str, kept: str) -> str:
    """Smoothed share of a term in whole units, exact."""
    return f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({whole} + 2 * {kept} as decimal(20,0))"


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def divergence(docs: DataFrame, id_column: str = "doc_id", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others, and by which terms.

    Part `pair`: every other source of the language, by the summed gap of the shares of all
    kept terms. Part `term`: the `top` kept terms a source uses more than its language.
    Gap of shares p and q: floor((p - q)^2 / (p + q)); shares are smoothed and in whole
    billionths, so all arithmetic is exact.

    A pair's sum is taken sparsely. Terms that neither source has all show one gap; terms of
    one source are grouped by their share and held against the other's share of nothing;
    only terms both have are joined, and correct that.

    Null text, lang and source count as ''. A language without kept terms gives pairs of
    value 0. A language of one source has no pairs. Null ids: see collapse; they change
    nothing in the result. Repeated rows are documents. Empty table: no rows. Other columns are not read.
    """
    counts = materialize(term_counts(docs, id_column), "term_counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least).drop("docs"), "kept_terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_size"))
    held = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "whole"), "held_terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sized = groups.join(held.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").join(languages, "lang", "left")
    sized = materialize(
        sized.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("kept", F.lit(0)).alias("kept"), "lang_size")
        .withColumn("none", F.expr(f"case when kept > 0 then {_share('0', 'size', 'kept')} end")),
        "groups",
    )
    shares = materialize(
        held.join(sized, ["lang", "source"]).select("lang", "source", "term", "none", F.expr(_share("n", "size", "kept")).alias("p"), F.expr(_share("whole", "lang_size", "kept")).alias("q")),
        "shares",
    )
    side = lambda df, end, *own: df.select("lang", *own, *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in ("lang", *own)])
    pairs = side(sized.select("lang", "kept", "source", "none"), "a", "kept").join(side(sized.select("lang", "source", "none"), "b"), "lang").where("source_a <> source_b")
    ends = ["lang", F.least("source_a", "source_b").alias("x"), F.greatest("source_a", "source_b").alias("y")]
    neither = pairs.where("source_a < source_b").select(*ends, F.expr(f"coalesce(kept * ({_gap('none_a', 'none_b')}), 0)").alias("value"))
    alike = shares.groupBy("lang", F.col("source").alias("source_a"), "p").agg(F.count("*").alias("terms"))
    one = alike.join(pairs, ["lang", "source_a"]).select(*ends, F.expr(f"terms * (({_gap('p', 'none_b')}) - ({_gap('none_a', 'none_b')}))").alias("value"))
    both = side(shares.drop("q"), "a", "term").join(side(shares.drop("q"), "b", "term"), ["lang", "term"]).where("source_a < source_b").select(
        *ends, F.expr(f"({_gap('p_a', 'p_b')}) - ({_gap('p_a', 'none_b')}) - ({_gap('none_a', 'p_b')}) + ({_gap('none_a', 'none_b')})").alias("value")
    )
    summed = neither.unionByName(one).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    pair = summed.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("e"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    pair = pair.select("lang", "e.*", "value", F.lit("pair").alias("part")).withColumn("rank", F.row_number().over(order)).select(*out)
    term = term.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*out)
    return pair.unionByName(term)

"""Secret scan: base patterns, and corpus-wide ownership of candidate values."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.core import materialize
from gristmill.llm.common import Batches, batch_of, map_arrow, plain

#: Fixed kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further candidates: long runs of key characters that mix letters and digits.
OTHER = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A value of more owners than this is a copied example; so is one that its few owners spread over more
#: repositories than this, as templates and defaults are.
OWNERS = 2
REPOSITORIES = 20
#: A value that makes up one in so many occurrences is judged by a small table sent to all tasks; there are at most this many.
FREQUENT = 4_096
#: Bits a character from which a further candidate looks drawn at random.
ENTROPY = 3.5
MASK = "<secret>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the three fixed kinds, by start, then kind."""
    spans = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def further_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Random-looking values outside the base spans: only candidates until their owners are counted."""
    out = []
    for m in OTHER.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not any(s < m.end() and m.start() < e for s, e, _, _ in base) and entropy(v) >= ENTROPY:
            out.append((m.start(), m.end(), "owned", v))
    return out


def digest(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.binary())])
SPANS = "array<struct<start:int,end:int,kind:string,value:binary>>"


def _scan(batches: Batches) -> Batches:
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            found.append([{"start": s, "end": e, "kind": k, "value": digest(v)} for s, e, k, v in base + (further_spans(text, base) if text else [])])
        columns = [*batch.columns, pa.array(found, pa.list_(_SPAN))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_spans"])


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value: repositories, owners, rows, live. candidates: (value, repository, owner).

    Values travel as 128-bit digests. Equal (value, owner, repository) rows meet in
    their own task first, so a value in a third of all documents stays a few rows.
    A null repository or owner counts as one of its own.
    """
    seen = candidates.groupBy("value", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).agg(F.count("*").alias("rows"))
    owners = seen.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("rows").alias("rows"))
    return owners.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("rows").alias("rows")).withColumn(
        "live", (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES)
    )


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with `secrets`: array of (start, end, kind, live), by start, then kind.

    Offsets are code points of the whole text. The three base kinds are always listed;
    live tells whether the value is found with few owners only. Further candidates
    (random-looking values) are listed as kind owned when live: widely copied examples
    and common identifiers drop out.

    repository and owner name columns, the repository being the unit below the owner: here a
    document of a source. A missing column or null counts as one unnamed owner or repository. Null and empty text: no spans. Repeated rows count once for ownership, and
    each gets its spans. Empty table: no rows. A column named secrets is replaced.
    """
    docs = docs.drop("secrets")
    keep = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    part = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    asked = docs.select("text", F.struct(*keep).alias("_row"), part(repository).alias("_repository"), part(owner).alias("_owner"))
    found = map_arrow(asked, _scan, plain(asked.schema) + f", `_spans` {SPANS}").select("_row", "_repository", "_owner", "_spans")
    found = materialize(found.withColumn("_n", F.monotonically_increasing_id()), "candidates")
    none = F.array().cast("array<struct<start:int,end:int,kind:string,live:boolean>>")
    clean = found.where("size(_spans) = 0").select("_row", none.alias("secrets"))
    each = found.where("size(_spans) > 0").select("_n", "_repository", "_owner", F.explode("_spans").alias("s"))
    judged = ownership(each.select(F.col("s.value").alias("value"), F.col("_repository").alias("repository"), F.col("_owner").alias("owner")))
    judged = materialize(judged, "owners")
    total = judged.agg(F.sum("rows")).first()[0] or 0
    often = judged.where(F.col("rows") * FREQUENT >= total).select("value", F.col("live").alias("known"))
    told = each.select("_n", "s.*").join(F.broadcast(often), "value", "left")  # so no frequent value meets in one task
    rest = told.where("known is null").drop("known").join(judged.select("value", "live"), "value")
    spans = told.where("known is not null").withColumnRenamed("known", "live").unionByName(rest).where("live or kind <> 'owned'")
    listed = spans.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("start", F.expr(f"array_position(array{KINDS}, kind)").alias("rank"), "end", "kind", "live"))).alias("spans"))
    hit = found.where("size(_spans) > 0").select("_n", "_row").join(listed, "_n", "left").select(
        "_row", F.coalesce(F.expr("transform(spans, s -> struct(s.start, s.end, s.kind, s.live))"), none).alias("secrets")
    )
    return clean.unionByName(hit).select("_row.*", "secrets")


def mask_secrets(docs: DataFrame, **names) -> DataFrame:
    """docs with every span that the scan lists replaced in text by a mask, n_chars made to fit; all rows stay."""
    order = docs.columns
    found = scan_secrets(docs, **names)

    def mask(batches: Batches) -> Batches:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("secrets").to_pylist()):
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [text[at : s["start"]], MASK]
                    at = max(at, s["end"])
                texts.append("".join(out) + text[at:] if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in order], names=order)

    hit = map_arrow(found.where("size(secrets) > 0"), mask, plain(docs.schema))
    out = found.where("size(secrets) = 0").select(*order).unionByName(hit)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*order) if "n_chars" in order else out


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, base_sha256, all spans as kind:start:end, and live and shared ones."""
    found = scan_secrets(docs, keep=["doc_id"])
    count = lambda c: F.expr(f"cast(size(filter(secrets, s -> {c})) as bigint)")
    listed = lambda a: F.expr(f"array_join(transform({a}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    return found.select(
        "doc_id", *[count(f"s.kind = '{k}'").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed("filter(secrets, s -> s.kind <> 'owned')").cast("binary"), 256).alias("base_sha256"),
        listed("secrets").alias("spans"), count("s.live").alias("n_live"), count("not s.live").alias("n_shared"),
    )

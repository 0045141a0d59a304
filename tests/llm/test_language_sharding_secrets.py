"""Language identification, sharding and the secret scan against plain versions."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gristmill.llm import langid, secrets, sharding
from gristmill.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba"])
    rng = np.random.default_rng(1)
    chances = rng.random((len(pieces.pieces) + 1, 2))
    for word in ("▁abba", "▁aé", "b"):
        cells = pieces.cells([word])
        got = langid.forward(cells, chances)[len(word)][0]
        want = np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            ids = [pieces.pieces.index(p) if p in pieces.pieces else len(pieces.pieces) if len(p) == 1 else None for p in parts]
            if None not in ids:
                want += np.prod(chances[ids], axis=0)
        assert np.allclose(got, want)
        counts = langid.expected_counts(cells, chances, np.ones((1, 2)))
        lengths = np.array([len(p) for p in pieces.pieces] + [1])
        assert np.allclose((counts * lengths[:, None]).sum(axis=0), len(word))


@pytest.fixture(scope="module")
def pieces():
    return langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_language_cases(spark, pieces):
    texts = {"en": "the cat and the dog are in the house of the king", "de": "der hund und die katze sind nicht in dem haus des königs"}
    rows = [(i, texts[("en", "de")[i % 2]] + " x" * (i % 5), ("en", "de")[i % 2], "s", 1) for i in range(30)] + [(90, "no label", None, "s", 1)]
    model = langid.train(spark.createDataFrame(rows, DOCS), pieces)
    assert model[0] == ["de", "en"]
    asked = spark.createDataFrame([(1, None, "en", "a", "b"), (2, "", "en", "a", "b"), (3, "12 !? ²", "en", "a", "b"), (4, "THE KING and the dog", None, "a", "b"),
                                   (4, "THE KING and the dog", None, "a", "b"), (None, "die katze " * 20_000, None, "a", "b"), (6, "x" * 5000, None, "a", "b")], "doc_id long, text string, lang string, score string, `a.b` string")
    got = langid.identify(asked, model, pieces)
    assert got.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score"]
    rows = got.collect()
    assert [r.lang_pred for r in rows[:6]] == ["und", "und", "und", "en", "en", "de"] and all(0 <= r.score <= 1 for r in rows) and rows[6].lang_pred in ("en", "de")
    none = langid.train(spark.createDataFrame([], DOCS), pieces)
    assert [r.lang_pred for r in langid.identify(asked, none, pieces).collect()] == ["und"] * 7
    assert langid.identify(asked.limit(0), model, pieces).count() == 0


def test_rare_languages_and_copies(spark, pieces, monkeypatch):
    common = spark.range(20_001).select(F.lit("the cat and the dog are in the house of the king").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([("der hund und die katze sind nicht in dem haus des königs", "de"), ("the king had a quick brown fox", "en")], "text string, lang string")
    model = langid.train(common.union(rare), pieces, per_language=2)
    assert model[0] == ["de", "en"]
    asked = spark.createDataFrame([(1, "der hund und das haus"), (2, "quick brown fox"), (3, "the house and the cat")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(asked, model, pieces).orderBy("doc_id").collect()] == ["de", "en", "en"]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.train(rare, pieces)


def test_held_out_accuracy(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(langid.training_rows(docs), pieces)
    held = langid.identify(docs.where(langid.fold(F.col("doc_id")) == 1), model, pieces)
    right, n = held.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 40 and right >= 0.97 * n


def test_hypergeometric_law():
    rng = np.random.default_rng(5)
    draws = [sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000)]
    want = [math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4) for k in range(5)]
    assert np.abs(np.bincount(draws, minlength=5) / 20_000 - want).max() < 0.015
    assert sharding.hypergeometric(rng, 10**12, 10**12, 10**11) == pytest.approx(5 * 10**10, rel=1e-4)


def test_matrix_sums():
    counts = [7, 0, 100, 13]
    matrix = np.array(sharding.communication_matrix(counts, 8, 3))
    assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == [15] * 8


@pytest.mark.parametrize("group", [20_000, 5])
def test_shards(spark, monkeypatch, group):
    monkeypatch.setattr(sharding, "ROWS_PER_GROUP", group)
    rows = [(i if i % 3 else None, None if i % 7 == 0 else "same" if i % 2 else "t" * i, i, "x", -1) for i in range(301)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place long, shard string, slot int").repartition(5)
    got = sharding.shuffle_to_shards(df, 16).toPandas()
    assert list(got.columns) == ["doc_id", "text", "place", "shard", "slot"] and sorted(got.place) == list(range(301))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert abs(np.corrcoef(got.place, got.shard)[0, 1]) < 0.25
    assert sharding.shuffle_to_shards(df.limit(0)).count() == 0


def test_base_spans():
    t = 'é api-key token="abc" SECRET : \'abcdef/+=\' secret:token:abcdefg passwd=short apikey=123456 AKIA' + "Z" * 16 + " AKIAX " + "0a" * 12 + "g" + "ab" * 11
    got = [(k, t[s:e]) for s, e, k, _ in secrets.base_spans(t)]
    assert got == [("assign", "SECRET : 'abcdef/+="), ("assign", "apikey=123456"), ("access", "AKIA" + "Z" * 16), ("hex", "0a" * 12)]


def test_ownership_parts_live_from_copied(spark):
    key = lambda n: hashlib.sha256(str(n).encode()).hexdigest()[:30].upper() + "xQ7z"
    rows = [(i, f"doc {i} {key(1)} end", "en", f"s{i}", 1) for i in range(8)]  # copied by eight sources
    rows += [(20, f"a {key(2)} b", "en", "s1", 1), (20, f"a {key(2)} b", "en", "s1", 1), (21, "token = abcdefgh", "en", None, 1), (22, None, None, None, None), (None, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = secrets.secret_digest(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.spans) for r in got if r.spans} == {(20, "owned:2:36"), (21, "assign:0:16")}
    assert next(r for r in got if r.doc_id == 21).base_sha256 == hashlib.sha256(b"assign:0:16").hexdigest()
    masked = {r.doc_id: (r.text, r.n_chars) for r in secrets.mask_secrets(docs).collect()}
    assert masked[20] == ("a <secret> b", 12) and masked[21] == ("<secret>", 8) and masked[0][0] == rows[0][1] and masked[22] == (None, None)
    assert secrets.scan_secrets(docs.drop("source").withColumn("secrets", F.lit(1))).columns[-1] == "secrets" and secrets.secret_digest(docs.limit(0)).count() == 0


def plain_digest(rows):
    """Ownership counted in plain Python, for documents as repositories and sources as owners."""
    found = []
    for i, t, _, source, _ in rows:
        base = secrets.base_spans(t or "")
        found.append((i, source, base, secrets.further_spans(t or "", base)))
    owners, repositories = {}, {}
    for i, source, base, more in found:
        for *_, v in base + more:
            owners.setdefault(v, set()).add(source or "")
            repositories.setdefault(v, set()).add((source or "", str(i) if i is not None else ""))
    live = {v for v in owners if len(owners[v]) <= secrets.OWNERS and len(repositories[v]) <= secrets.REPOSITORIES}
    return sorted((i or 0, ",".join(f"{k}:{s}:{e}" for s, e, k, v in sorted(base + [(s, e, "owned", v) for s, e, _, v in more if v in live], key=lambda x: (x[0], secrets.KINDS.index(x[2])))),
                   sum(v in live for *_, v in base + more)) for i, _, base, more in found)


@pytest.mark.parametrize("frequent", [1, 4_096])
def test_both_counts_judge(spark, monkeypatch, frequent):
    """A value of one owner is live up to a number of repositories; of many owners it never is."""
    monkeypatch.setattr(secrets, "FREQUENT", frequent)
    key = lambda n: hashlib.sha256(str(n).encode()).hexdigest()[:30].upper() + "xQ7z"
    spread = secrets.REPOSITORIES
    rows = [(i, f"use {key(1)} here", "en", "one", 1) for i in range(spread)] + [(100 + i, f"use {key(2)} here", "en", "one", 1) for i in range(spread + 1)]
    rows += [(200 + i, f"use {key(3)} here", "en", f"s{i}", 1) for i in range(3)] + [(300 + i, f"use {key(14)} and password=hunter2{i % 2}", "en", f"s{i % 2}", 1) for i in range(6)]
    rows += [(400, f"{key(5)} " * 3 + "token: abcdef1", "en", None, 1), (400, f"{key(5)} " * 3 + "token: abcdef1", "en", None, 1), (None, f"x {key(5)}", "en", "s1", 1), (401, None, "en", "s", 0), (402, "", None, None, 0)]
    rows += [(500, f"é {key(6)} " + "filler words " * 40_000 + key(7), "en", "long", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = secrets.secret_digest(docs).collect()
    want = plain_digest(rows)
    assert sorted((r.doc_id or 0, r.spans, r.n_live) for r in got) == want
    assert {i for i, spans, _ in want if "owned" in spans} == {*range(spread), *range(300, 306), 400, 0, 500}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 30), (30, 40), (40, 50), (50, 20)] + [(100, 100 + i) for i in range(1, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 8: 7, 9: 7, 30: 20, 40: 20, 50: 20} | {100 + i: 100 for i in range(1, 60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crc_of_query(spark):
    from gristmill.llm.queries import op3_sharding

    got = op3_sharding(spark, "/root/testdata/sf0.001").toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got.itertuples():
        data = docs[r.doc_id].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "rows"

"""Centroid clustering, source divergence and lattice hashing against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import centroids, divergence, lattice

VECTORS = "vec_id long, embedding array<float>, label int, v string, cells int"


def plain_nearest(x, centres):
    out = []
    for row in x.tolist():
        gaps = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centres.tolist()]
        out.append((gaps.index(min(gaps)), min(gaps)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_walk_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    wide = (2, 5, 100, centroids.LARGEST)[seed % 4]  # narrow values give many ties
    k, d = (1, 3, 16, 40)[seed // 2], (1, 2, 64, 7)[seed % 4]
    x, c = rng.integers(-wide, wide + 1, (200, d)), rng.integers(-wide, wide + 1, (k, d))
    c[-1] = c[0]
    near, gap = centroids.nearest(x, c)
    assert list(zip(near.tolist(), gap.tolist())) == plain_nearest(x, c)


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)[:k]
    centres = np.array([v for *_, v in first])
    x = np.array([v for _, v in kept])
    for _ in range(rounds):
        near = [n for n, _ in plain_nearest(x, centres)]
        centres = np.array([[sum(t) // near.count(c) for t in zip(*x[[n == c for n in near]].tolist())] if c in near else centres[c].tolist() for c in range(len(centres))])
    placed = plain_nearest(x, centres)
    own = Counter()
    for c, gap in placed:
        own[c] += gap
    return Counter((i, c, gap, own[c], sum(own.values()), tuple(centres[c].tolist())) for (i, _), (c, gap) in zip(kept, placed))


def test_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(150)]
    rows += [(500 + i, rows[3][1]) for i in range(60)] + [rows[5]] * 3  # a crowd of equal vectors, repeated rows
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (905, [float("inf")] * 64), (906, [1e30] * 64), (None, [0.5] * 64), (907, [0.0] * 64), (908, [-0.001] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(5)
    got = Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in centroids.cluster(df).collect())
    assert got == plain_clusters([r for r in rows if r[0] != 906])
    assert centroids.cluster(df.limit(0)).count() == 0
    few = centroids.cluster(df.where("vec_id < 5")).collect()
    assert len(few) == 5 and {r.distance for r in few} == {0} and len({r.cluster for r in few}) == 5
    assert few[0].asDict().keys() == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"}
    assert centroids.centroid_digest([1, -2]) == hashlib.sha256(b"1,-2").hexdigest()


def plain_divergence(rows, least):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((g or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))) for _, t, g, s in rows]
    out = set()
    for lang in {g for g, _, _ in docs}:
        own = [(s, w) for g, s, w in docs if g == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        by = defaultdict(Counter)
        for s, w in own:
            by[s].update(t for t in w if t in kept)
        whole = sum(by.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in by.items()}, share(whole)
        for s in by:
            parts = {"pair": [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s],
                     "term": [(gap(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found = sorted(found, key=lambda f: (-f[0], f[1].encode()))
                out |= {(lang, s, part, item, value, n) for n, (value, item) in enumerate(found, 1) if part == "pair" or n <= 10}
    return out


@pytest.mark.parametrize("held", [3, 200_000])
def test_divergence(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(6)
    words = ["alpha", "Beta", "été", "ÉTÉ", "naïve", "日本", "x", "zeta", "don", "t", "ß"]
    text = lambda: " ".join(rng.choices(words, range(1, 12), k=rng.randrange(0, 30))) + rng.choice(["", "!", " 12-a_b", "\t\x00c"])
    copies = [text() for _ in range(5)]
    rows = [(i, rng.choice([text(), copies[i % 5]]), rng.choice(["en", "fr", None, ""]), f"s{rng.randrange(5)}") for i in range(400)]
    rows += [(1000 + i, copies[0], "en", f"s{i % 3}") for i in range(200)] + [rows[7]] * 40  # a hot text, repeated rows
    rows += [(None, copies[1], "en", None), (None, None, None, None), (5, "", "de", "a"), (6, "long " * 60_000, "en", "s1"), (7, "onlyhere", "de", "b"), (8, "q" * 50_000, "it", "z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, p int, term int").repartition(6)
    got = [tuple(r) for r in divergence.divergence(df).collect()]
    assert set(got) == plain_divergence(rows, 10) and len(set(got)) == len(got)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_equal_texts_are_split_once(spark):
    rows = [(i, "the same text", "en", f"s{i % 4}") for i in range(500)] + [(1000 + i, f"other {i}", "en", "s0") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8)
    sent = divergence.collapse(df).where("text is not null").groupBy("h1", "h2").count()
    assert {r["count"] for r in sent.collect()} == {1} and sent.count() == 51  # the hot text comes from one row
    assert divergence.collapse(df).select(F.explode("copies").alias("n")).agg(F.sum("n")).first()[0] == 550


def test_lattice_points():
    rng = np.random.default_rng(1)
    n = lattice.NEIGHBOURS
    assert len(n) == 240 and np.allclose((n * n).sum(axis=1), 2) and len(np.unique(n, axis=0)) == 240
    x = rng.standard_normal((500, 8)) * 2
    p = lattice.nearest_point(x)
    whole = (p == np.rint(p)).all(axis=1)
    assert (whole | (p - 0.5 == np.rint(p - 0.5)).all(axis=1)).all() and not (p.sum(axis=1) % 2).any()
    gap = ((x - p) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all() and (gap <= ((x[:, None] - p[:, None] - n) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def plain_near(rows, similar=0.98):
    usable = lambda v, g: g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    nodes = sorted({(i, tuple(v), g) for i, v, g in rows if i is not None and usable(v, g)})
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(nodes)
    for g in {n[2] for n in nodes}:
        for d in {len(n[1]) for n in nodes}:
            own = [k for k, n in enumerate(nodes) if n[2] == g and len(n[1]) == d]
            if own:
                x = lattice.unit_rows(np.array([nodes[k][1] for k in own], float))
                for a, b in zip(*np.nonzero(np.triu(x @ x.T >= similar, 1))):
                    links[own[a]] += 1
                    links[own[b]] += 1
                    lo, hi = sorted((find(own[a]), find(own[b])))
                    root[hi] = lo
    told = {n: (links[k], nodes[find(k)][0]) for k, n in enumerate(nodes)}
    return Counter((i, *told.get((i, tuple(v) if v else None, g) if i is not None else None, (0, i))) for i, v, g in rows)


@pytest.mark.parametrize("part", [16, 2_048])
def test_near_vectors(spark, monkeypatch, part):
    """Groups of near vectors around the limit, a crowd of copies, odd rows; crowded cells dealt into parts."""
    monkeypatch.setattr(lattice, "PART", part)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(2, 40)):
            rows.append((len(rows), (base + rng.standard_normal(64) * 0.1).astype(np.float32).tolist(), int(g % 3)))
    rows += [(1000 + i, rng.standard_normal(64).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(50)] + [rows[9]] * 3 + [(9, rows[40][1], 5)]
    short = rng.standard_normal(5).astype(np.float32).tolist()
    rows += [(3000, short, 1), (3001, [2 * x for x in short], 1), (3002, short, 2), (3003, short[:4], 1), (3004, [1.0], 1), (3005, [2.0], 1), (3006, [-1.0], 1)]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 64, 1), (4003, [float("nan")] * 64, 1), (4004, [None] + [1.0] * 63, 1), (4005, rows[0][1], None), (None, rows[0][1], 0), (4006, [float("inf")] * 64, 1), (4007, [1e30] * 64, 7), (4008, [2e30] * 64, 7), (4009, [1e-40] * 64, 7)]
    df = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], VECTORS).repartition(5)
    got = lattice.near_vectors(df, missed=1e-6).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == plain_near(rows)
    assert lattice.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in lattice.near_vectors(df.where("vec_id = 4000")).collect()] == [(4000, 0, 4000, True)]


def test_near_vectors_recall(spark):
    """Pairs exactly at the limit of what must be found, at the default parameters."""
    rng = np.random.default_rng(4)
    x = lattice.unit_rows(rng.standard_normal((600, 64)))
    side = rng.standard_normal(x.shape)
    side = lattice.unit_rows(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.9801 * x + math.sqrt(1 - 0.9801**2) * side
    rows = [(2 * i, a.tolist(), 1) for i, a in enumerate(x)] + [(2 * i + 1, a.tolist(), 1) for i, a in enumerate(y)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links > 0").count() >= 0.99 * len(rows)
    for n in (1_000, 10**6, 10**9):
        spread, tables = lattice.plan(n, 64)
        assert 2 <= tables <= 40 and 0.2 < spread < 1

"""Drift, streaming and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import new_path
from ..operators import drift as D
from ..operators import retrieve as R
from ..streaming import incremental as I
from .registry import query, rounded, table, union_sql

MIDDLE = "TIMESTAMP '2024-01-15 00:00:00'"


def halves(spark, sf_dir):
    """Events before and after the middle of the month."""
    events = table(spark, sf_dir, "events")
    middle = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)


_EDGES = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
_BINNED = f"""x AS (SELECT list_distinct([{_EDGES}]) AS edges FROM events WHERE ts < {MIDDLE}),
v AS (SELECT ts, len(list_filter(edges, lambda e: e < value))::VARCHAR AS bin FROM events, x),
b AS (SELECT bin, greatest(count(*)::DOUBLE / sum(count(*)) OVER (), 1e-6) AS e FROM v WHERE ts < {MIDDLE} GROUP BY bin)"""


def _scores(a: str, e: str) -> str:
    return f"round(sum(({a} - {e}) * ln({a} / {e})), 6) AS psi, round(sum({a} * ln({a} / {e})), 6) AS kl"


_FULL = f"""c AS (SELECT bin, count(*) AS n, greatest(count(*)::DOUBLE / sum(count(*)) OVER (), 1e-6) AS a FROM v WHERE ts >= {MIDDLE} GROUP BY bin)
SELECT '{{column}}' AS "column", sum(n)::BIGINT AS n, {_scores('coalesce(a, 1e-6)', 'coalesce(e, 1e-6)')} FROM b FULL JOIN c USING (bin)"""


@query("drift_numeric", f"WITH {_BINNED}, {_FULL.format(column='value')}")
def drift_numeric(spark, sf_dir):
    return rounded(D.drift(*halves(spark, sf_dir), "value"))


@query("drift_categorical", f"""WITH v AS (SELECT ts, event_type AS bin FROM events),
b AS (SELECT bin, greatest(count(*)::DOUBLE / sum(count(*)) OVER (), 1e-6) AS e FROM v WHERE ts < {MIDDLE} GROUP BY bin), {_FULL.format(column='event_type')}""")
def drift_categorical(spark, sf_dir):
    return rounded(D.drift(*halves(spark, sf_dir), "event_type"))


_WINDOWS = f"""w AS (SELECT date_trunc('day', ts) AS day, bin, count(*) AS n FROM v {{where}} GROUP BY ALL),
t AS (SELECT day, sum(n)::BIGINT AS n FROM w GROUP BY day),
g AS (SELECT t.day, t.n AS total, b.bin, b.e FROM t, b)
SELECT g.day AS window_start, max(total) AS n,
  {_scores('greatest(coalesce(w.n, 0)::DOUBLE / total, 1e-6)', 'g.e')}
FROM g LEFT JOIN w ON w.day = g.day AND w.bin = g.bin GROUP BY g.day"""


@query("drift_by_window", f"WITH {_BINNED}, {_WINDOWS.format(where='WHERE ts >= ' + MIDDLE)}")
def drift_by_window(spark, sf_dir):
    before, after = halves(spark, sf_dir)
    return rounded(D.drift_by_window(D.fit_baseline(before, "value"), after, "ts"))


@query("drift_published", f"""WITH {_BINNED}, {_FULL.format(column='value')}""")
def drift_published(spark, sf_dir):
    """Scores against a published baseline, read back by its version after a later one was published."""
    before, after = halves(spark, sf_dir)
    path = new_path(spark, "baselines")
    version = D.publish_baseline(D.fit_baseline(before, "value"), path)
    D.publish_baseline(D.fit_baseline(after, "value", bins=4), path)
    base = D.load_baseline(spark, path, version)
    return rounded(D.drift_scores(D.bin_counts(after, base), base).select(F.lit("value").alias("column"), "n", "psi", "kl"))


@query("stream_drift", f"""WITH {_BINNED}, {_WINDOWS.format(
    where="WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")}""")
def stream_drift(spark, sf_dir):
    before, _ = halves(spark, sf_dir)
    stream = I.read_files(spark, sf_dir, table(spark, sf_dir, "events").schema, name_glob="events.parquet", files_per_trigger=1)
    out = I.drift_stream(stream, D.fit_baseline(before, "value"), "ts")
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("stream_profile", union_sql([
    f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, 0.0::DOUBLE AS missing_pct, round(avg({c}), 6) AS mean,
  round(stddev_pop({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM events""" for c in ("value", "user_id")]))
def stream_profile(spark, sf_dir):
    stream = I.read_files(spark, sf_dir, table(spark, sf_dir, "events").schema, name_glob="events.parquet", files_per_trigger=1)
    return rounded(I.profile_stream(stream, ["value", "user_id"]))


@query("vector_topk", """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS d FROM embeddings),
m AS (SELECT label, d, avg(v) AS v FROM x GROUP BY ALL), q AS (SELECT label, list(v ORDER BY d) AS c FROM m GROUP BY label),
s AS (SELECT q.label::VARCHAR AS query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS similarity FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM s)
SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def vector_topk(spark, sf_dir):
    """Nearest stored vectors of each label's mean vector."""
    vectors = table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("d", "v")).groupBy("label", "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("c"))
    )
    return rounded(R.top_k_similar(vectors, "vec_id", "embedding", means, "label", "c", 5))


@query("vector_topk_all", """
WITH p AS (SELECT a.vec_id::VARCHAR AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
  FROM embeddings a, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM p)
SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 3""")
def vector_topk_all(spark, sf_dir):
    """Nearest stored vectors of every vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(R.top_k_similar(vectors, "vec_id", "embedding", vectors, "vec_id", "embedding", 3))

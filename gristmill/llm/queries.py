"""The named queries of these operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import centroids, contamination, divergence, extract, langid, lattice, multiindex, neardup, packing, secrets, sharding, urls, wavelet
from gristmill.llm.common import read_text, table, utf8_size


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.train(langid.training_rows(docs), pieces)
    found = langid.identify(docs.select("doc_id", "text"), model, pieces)
    return found.select("doc_id", (langid.fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_to_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return placed.select(
        "doc_id", (utf8_size("text") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_digest(table(spark, sf_dir, "documents"), read_text(public_tokenizers.path("word_bpe_49k.json")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(urls.labelled(spark)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), read_text(public_tokenizers.path("byte_bpe_50k.json")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_decontamination, op3_sharding, op4_secret_scan, op5_token_binary,
    op6_html_extraction, op7_multi_index, op8_near_duplicates, op9_url_filter, op10_packing,
    op11_centroid_clustering, op12_source_divergence, op13_embedding_near_duplicates,
)}

#: One round of assigning and moving, r the round.
_NEAR = """
near{r} as (
  select row, any_value(vec_id) vec_id, any_value(v) v, arg_min(c, (d, c)) c, min(d) d from (
    select row, vec_id, v, c, cast(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, w)]) as bigint) d from kept, centres{r}) group by row)"""
_MOVE = """,
centres{s} as (
  select c, coalesce(m.w, o.w) w from centres{r} o left join (
    select c, list(cast((t - ((t % n) + n) % n) // n as bigint) order by j) w from (
      select c, j, sum(v[j]) t, count(*) n from (select c, v, unnest(generate_series(1, 64)) j from near{r}) group by c, j) group by c) m using (c)),"""

ORACLES = {
    "op11_centroid_clustering": r"""
with kept as (
  select row_number() over () as row, vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] v
  from embeddings where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
centres0 as (
  select cast(row_number() over (order by h, v) - 1 as integer) c, v w from (select *, sha256('1:' || vec_id) h from kept) qualify row_number() over (order by h, v) <= 16),"""
    + "".join(_NEAR.format(r=r) + _MOVE.format(r=r, s=r + 1) for r in range(3)) + _NEAR.format(r=3) + r"""
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(w, ',')) centroid_sha256
from near3 join centres3 using (c)""",
    "op12_source_divergence": r"""
with docs as (select row_number() over () as row, coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source from documents),
terms as (
  select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
kept as (select lang, term, count(*) n from terms group by 1, 2 having count(distinct row) >= 10),
langs as (select lang, count(*) v, sum(n) big from kept group by 1),
counts as (select lang, source, term, count(*) n from terms semi join kept using (lang, term) group by 1, 2, 3),
sizes as (select lang, source, sum(n) big from counts group by 1, 2),
groups as (select distinct lang, source from docs),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n,
    1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2)) // (coalesce(s.big, 0) + 2 * l.v) p, 1 + (cast(1000000000 as hugeint) * (k.n + 2)) // (l.big + 2 * l.v) q
  from groups g join kept k using (lang) join langs l using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
    left join sizes s on s.lang = g.lang and s.source = g.source),
gaps as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) f from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, b.source item, cast(coalesce(f, 0) as bigint) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join gaps g on g.lang = a.lang and g.source = a.source and g.item = b.source),
tops as (select lang, source, term item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from shares where n > 0 and p > q)
select lang, source, 'pair' part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) rank from pairs
union all
select lang, source, 'term' part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) rank from tops
qualify row_number() over (partition by lang, source order by value desc, item) <= 10""",
    "op13_embedding_near_duplicates": r"""
with recursive good as (
  select distinct vec_id, label, cast(embedding as double[]) v from embeddings
  where label is not null and vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
links as (select a.vec_id a, b.vec_id b from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select vec_id a, vec_id b from good union select r.a, l.b from reach r join links l on r.b = l.a),
lowest as (select a, min(b) component_id from reach group by 1),
counted as (select a, count(*) n from links group by 1)
select e.vec_id, cast(coalesce(n, 0) as bigint) n_links, coalesce(component_id, e.vec_id) component_id, e.vec_id = coalesce(component_id, e.vec_id) kept
from embeddings e left join lowest on lowest.a = e.vec_id left join counted on counted.a = e.vec_id""",
    "op2_decontamination": r"""
with words_of as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
sized as (select item_id, w, least(10, len(w)) m from items where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') k from (select *, unnest(generate_series(1, len(w) - m + 1)) i from sized)),
lens as (select distinct m from win),
grams as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') k from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) i from words_of, lens where len(w) >= m)),
found as (select g.doc_id, g.i, g.m, win.item_id from grams g join win on g.m = win.m and g.k = win.k),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + m - 1)) p from found) group by 1),
named as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) names from found group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from words_of d left join hit using (doc_id) left join named using (doc_id)""",
}

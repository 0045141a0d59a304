"""Text profile, cleaning and term-vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import spread
from ..functions import text as X
from ..operators import textprep as C
from ..operators import textprofile as P
from .registry import query, rounded, table, union_sql

TOKENS = f"regexp_extract_all(lower(text), '{X.WORD.replace(chr(39), chr(39) * 2)}')"
TEXT_GAPS = """(SELECT doc_id, lang, CASE WHEN lang = 'de' THEN '' WHEN doc_id % 7 = 0 THEN NULL
  WHEN doc_id % 11 = 0 THEN ' ' || chr(9) || chr(10) ELSE text END AS text FROM documents)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def text_gaps(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", "lang",
        F.when(F.col("lang") == "de", "").when(F.col("doc_id") % 7 == 0, None)
        .when(F.col("doc_id") % 11 == 0, " \t\n").otherwise(F.col("text")).alias("text"),
    )


@query("text_missing_counts", f"""
SELECT count(*) AS rows, count(*) - count(text) AS missing_text, count(*) FILTER (text = '') AS empty_text,
  count(*) FILTER (regexp_full_match(text, '[\\s\\p{{Z}}]*')) AS whitespace_only FROM {TEXT_GAPS}""")
def text_missing_counts(spark, sf_dir):
    return P.text_counts(text_gaps(spark, sf_dir), "text")


_STATS = """count(v) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v)::DOUBLE AS min,
  round(quantile_cont(v::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(v::DOUBLE, 0.9), 6) AS p90,
  round(quantile_cont(v::DOUBLE, 0.99), 6) AS p99, max(v)::DOUBLE AS max"""


@query("text_length_profile", union_sql([
    f"""SELECT '{name}' AS "column", {_STATS} FROM (SELECT {e} AS v FROM documents)"""
    for name, e in [("char_lengths", "length(text)"), ("word_lengths", f"len({TOKENS})")]
]))
def text_length_profile(spark, sf_dir):
    return rounded(P.length_profile(documents(spark, sf_dir), "text"))


@query("top_unigrams", f"""
SELECT token, count(*) AS count FROM (SELECT unnest({TOKENS}) AS token FROM documents)
GROUP BY token ORDER BY count DESC, token LIMIT 30""")
def top_unigrams(spark, sf_dir):
    return P.top_tokens(documents(spark, sf_dir), "text")


@query("top_bigrams", f"""
WITH t AS (SELECT {TOKENS} AS w FROM documents),
b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS token FROM t)
SELECT token, count(*) AS count FROM b GROUP BY token ORDER BY count DESC, token LIMIT 30""")
def top_bigrams(spark, sf_dir):
    return P.top_tokens(documents(spark, sf_dir), "text", n=2)


@query("vocabulary_size", f"""
SELECT count(DISTINCT token) AS vocab_estimate FROM (SELECT unnest({TOKENS}) AS token FROM documents)""")
def vocabulary_size(spark, sf_dir):
    return P.vocabulary_size(documents(spark, sf_dir), "text")


def labelled(spark, sf_dir):
    """Documents with their quality label; most have none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


@query("label_text_lengths", f"""
SELECT coalesce(quality::VARCHAR, 'NaN') AS label, round(avg(length(text)), 6) AS mean_chars,
  round(avg(len({TOKENS})), 6) AS mean_words FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_text_lengths(spark, sf_dir):
    return rounded(P.label_lengths(labelled(spark, sf_dir), "text", "quality"))


@query("label_preview", """
WITH f AS (SELECT quality AS v, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT 'n_classes' AS metric, NULL::VARCHAR AS key, count(v)::DOUBLE AS value FROM f
UNION ALL SELECT 'imbalance_ratio', NULL, round(max(n)::DOUBLE / min(n), 6) FROM f
UNION ALL SELECT 'class_count', coalesce(v::VARCHAR, 'NaN'), n::DOUBLE FROM f""")
def label_preview(spark, sf_dir):
    return rounded(P.label_preview(labelled(spark, sf_dir), "quality"))


_REPEATS = "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1"


@query("duplicate_texts", f"SELECT count(*) AS duplicate_texts FROM ({_REPEATS})")
def duplicate_texts(spark, sf_dir):
    return P.duplicate_texts(documents(spark, sf_dir), "text")


@query("top_duplicate_texts", f"""
SELECT substr(text, 1, 120) AS text, n AS count FROM ({_REPEATS}) ORDER BY n DESC, substr(text, 1, 120) LIMIT 10""")
def top_duplicate_texts(spark, sf_dir):
    return P.top_duplicate_texts(documents(spark, sf_dir), "text")


def _share(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))::DOUBLE / nullif(length(text), 0)"


@query("char_makeup", f"""
SELECT round(avg(coalesce({_share('[0-9]')}, 0) * 100), 6) AS digits_pct_mean,
  round(avg(coalesce({_share('[^[:space:]' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 'p{Z}]')}, 0) * 100), 6) AS punct_pct_mean,
  round(avg(coalesce({_share('[A-Z]')}, 0) * 100), 6) AS upper_pct_mean FROM documents""")
def char_makeup(spark, sf_dir):
    return rounded(P.character_makeup(documents(spark, sf_dir), "text"))


# The stopword list published with Spark's StopWordsRemover (English).
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's
we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's
who's why's would
""".split()


def _stop_list() -> str:
    """The English stopword list as SQL text."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"


@query("clean_words", f"""
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'),
  lambda t: regexp_replace(lower(t), '[^a-zA-Z0-9]', '', 'g')) AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda t: t <> '' AND NOT list_contains({_stop_list()}, t)), ' ') AS clean_text
FROM w""")
def clean_words(spark, sf_dir):
    return C.clean_words(documents(spark, sf_dir), "text").select("doc_id", "clean_text")


@query("stem_words")
def stem_words(spark, sf_dir):
    return C.clean_words(documents(spark, sf_dir), "text", stemming=True).select("doc_id", "clean_text")


def _clean_sql(source: str) -> str:
    e = source
    e = f"regexp_replace(regexp_replace({e}, '{X.HTML_TAG}', ' ', 'g'), '{X.HTML_ENTITY}', ' ', 'g')"
    e = f"regexp_replace({e}, '{X.URL_OR_EMAIL}', ' ', 'g')"
    e = f"lower({e})"
    for short, long in X.CONTRACTIONS:
        e = f"regexp_replace({e}, '(?i){short.replace(chr(39), chr(39) * 2)}', '{long}', 'g')"
    e = f"regexp_replace({e}, '\\p{{Nd}}+', ' ', 'g')"
    e = f"regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g')"
    return f"trim(regexp_replace({e}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query("clean_text_switches", f"SELECT page_id, {_clean_sql('html')} AS clean_text FROM pages")
def clean_text_switches(spark, sf_dir):
    cfg = C.CleaningSwitches(unicode_norm=False, strip_numbers=True, stopwords=False)
    return C.clean_text(table(spark, sf_dir, "pages"), "html", cfg=cfg).select("page_id", "clean_text")


@query("clean_text_default")
def clean_text_default(spark, sf_dir):
    return C.clean_text(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "clean_text")


@query("lemmatize_words", """
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: t <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM w)
SELECT doc_id, string_agg(CASE WHEN length(tok) >= 7 THEN substr(tok, 1, 5) || 'X' ELSE tok END, ' ' ORDER BY pos) AS clean_text FROM x GROUP BY 1""")
def lemmatize_words(spark, sf_dir):
    """All documents, with a lemma for each of their longer words."""
    words = C.clean_words(documents(spark, sf_dir), "text", "words", stopwords=False).select(F.explode(F.split("words", " ")).alias("token")).distinct()
    lemmas = words.where(F.length("token") >= 7).select("token", F.concat(F.substring("token", 1, 5), F.lit("X")).alias("lemma"))
    return C.clean_words(documents(spark, sf_dir), "text", stopwords=False, lemmas=lemmas).select("doc_id", "clean_text")


_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')"


def _tfidf_sql(limit: int, terms: str = _TERMS) -> str:
    return f"""
WITH t AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {limit}),
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("tfidf_weights", _tfidf_sql(500))
def tfidf_weights(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = C.fit_term_vectors(docs, "text", max_features=500)
    return rounded(C.vector_entries(model.transform(spread(docs)), "features", ["doc_id"], C.vocabulary_of(model)))


@query("bag_of_words", """
WITH d AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+') AS w FROM conversations),
t AS (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 2000)
SELECT conv_id, turn, term, tf::DOUBLE AS weight FROM tf JOIN v USING (term)""")
def bag_of_words(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    model = C.fit_term_vectors(docs, "text", kind="bow", ngram=(1, 2), max_features=2000)
    return C.vector_entries(model.transform(docs), "features", ["conv_id", "turn"], C.vocabulary_of(model))


@query("mean_pool", """
SELECT label, dim::INTEGER AS dim, round(avg(x), 6) AS value FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings WHERE vec_id % 5 <> 0)
GROUP BY ALL""")
def mean_pool(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 5 != 0).cast("int"))
    return rounded(C.mean_pool(vectors, "label", "embedding", "mask"))

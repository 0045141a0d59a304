"""Whole reports, next to the SQL of their sections in the same form."""

from __future__ import annotations

from ..plans import reports as R
from .files import IMAGES, images
from .models import _board
from .registry import ORACLES, query, rounded, table, union_sql
from .tables import ORDERS_CLASSES, _categories_sql, _iso, _numeric_sql, _outlier_sql, _pairs_sql
from .text import labelled

# --- image report ------------------------------------------------------------

_EACH_IMAGE = f"SELECT path, class, CASE WHEN NOT bad THEN w END AS width, CASE WHEN NOT bad THEN h END AS height, CASE WHEN NOT bad THEN m END AS mode FROM {IMAGES}"
_SIZES = union_sql([f"""SELECT '{n}' AS c, {{count}} count(v)::DOUBLE AS count, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90,
  quantile_cont(v, 0.99) AS p99, max(v) AS max FROM (SELECT ({e})::DOUBLE AS v FROM i WHERE width IS NOT NULL)""".replace("{count} ", "") for n, e in [("width", "width"), ("height", "height"), ("aspect", "width::DOUBLE / height")]])
_REPORT = f"""WITH i AS ({_EACH_IMAGE}), per AS (SELECT class, count(*) AS n FROM i GROUP BY 1), s AS ({_SIZES}),
g AS (SELECT count(*)::DOUBLE AS images, count(width)::DOUBLE AS readable, (count(*) - count(width))::DOUBLE AS corrupt, (count(*) - count(width)) * 100.0::DOUBLE / count(*) AS corrupt_pct,
  (count(*) FILTER (width < 32 OR height < 32))::DOUBLE AS very_small FROM i),
r AS (SELECT 'classes' AS section, NULL AS "column", unnest(['n_images', 'n_classes']) AS metric, unnest([(SELECT sum(n) FROM per)::DOUBLE, (SELECT count(*) FROM per)::DOUBLE]) AS value, NULL AS text
UNION ALL SELECT 'class_counts_top20', NULL, 'n', n, class FROM (SELECT * FROM per ORDER BY n DESC, class LIMIT 20)
UNION ALL SELECT 'small_classes_lt10', NULL, 'n', n, class FROM (SELECT * FROM per WHERE n < 10 ORDER BY class LIMIT 50)
{' '.join(f"UNION ALL SELECT 'integrity', NULL, '{c}', {c}, NULL FROM g" for c in ('images', 'readable', 'corrupt', 'corrupt_pct', 'very_small'))}
{' '.join(f"UNION ALL SELECT 'sizes', c, '{c}', {c}, NULL FROM s" for c in ('count', 'mean', 'std', 'min', 'p50', 'p90', 'p99', 'max'))}
UNION ALL SELECT 'mode_counts_top', NULL, 'n', n, mode FROM (SELECT mode, count(*) AS n FROM i WHERE mode IS NOT NULL GROUP BY 1 ORDER BY n DESC, mode LIMIT 10)
UNION ALL SELECT 'sample_paths', NULL, 'path', NULL, path FROM (SELECT path FROM i ORDER BY path LIMIT 8))
SELECT section, "column", metric, round(value, 6) AS value, text FROM r"""


@query("image_report", _REPORT)
def image_report(spark, sf_dir):
    return rounded(R.image_report(images(spark, sf_dir)))


# --- table and text report ---------------------------------------------------


def tidy_sql(sql: str, section: str, metrics: list[str], key: str = "NULL", texts: tuple[str, ...] = ()) -> str:
    """The rows of a result as (section, column, metric, value, text)."""
    return union_sql([
        f"""SELECT '{section}' AS section, {key} AS "column", '{m}' AS metric, {'NULL' if m in texts else f'"{m}"'}::DOUBLE AS value, {f'"{m}"' if m in texts else 'NULL'}::VARCHAR AS text FROM ({sql})"""
        for m in metrics
    ])


def _named(sql: str, section: str, key: str, metric: str, value: str, text: str) -> str:
    return f"""SELECT '{section}', {key}, {metric}, ({value})::DOUBLE, {text} FROM ({sql})"""


_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_SPREAD = ["count", "missing", "missing_pct", "mean", "std", "min", "max", "p1", "p5", "p25", "p50", "p75", "p95", "p99"]
_STATUS = "SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1"
_TARGET = f"""SELECT 'n_classes' AS metric, NULL AS key, count(v)::DOUBLE AS value FROM ({_STATUS})
UNION ALL SELECT 'imbalance_ratio', NULL, round(max(n)::DOUBLE / min(n), 6) FROM ({_STATUS})
UNION ALL SELECT * FROM (SELECT 'class_count', v, n::DOUBLE FROM ({_STATUS}) ORDER BY n DESC, v LIMIT 50)"""


def _repeated(source: str) -> str:
    return f"""SELECT sum(n)::BIGINT AS rows, (sum(n) - count(*))::BIGINT AS duplicate_rows, round((sum(n) - count(*)) * 100.0::DOUBLE / sum(n), 6) AS duplicate_rows_pct
  FROM (SELECT count(*) AS n FROM {source} GROUP BY ALL)"""


_COLUMN = '"column"'
_FILLED = union_sql([f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM orders""" for c in ORDERS_CLASSES])
_ANY_MISSING = " OR ".join(f"{c} IS NULL" for c in ORDERS_CLASSES)


@query("table_report", union_sql([
    tidy_sql(ORACLES["table_shape"], "shape", ["rows", "cols"]),
    tidy_sql(f"SELECT * REPLACE (high_cardinality::INTEGER AS high_cardinality) FROM ({ORACLES['schema_summary']})", "schema_summary", ["dtype", "null_count", "nunique", "high_cardinality"], _COLUMN, ("dtype",)),
    tidy_sql(ORACLES["memory_summary"], "memory_summary", ["bytes"], _COLUMN),
    tidy_sql(_repeated("(SELECT *, 0 AS one FROM orders)").replace("count(*) AS n FROM", "*, count(*) AS n FROM"), "duplicate_summary", ["rows", "duplicate_rows", "duplicate_rows_pct"]),
    tidy_sql(f"""SELECT 'o_orderdate' AS "column", {_iso('min(o_orderdate)')} AS min, {_iso('max(o_orderdate)')} AS max FROM orders""", "datetime_overview", ["min", "max"], _COLUMN, ("min", "max")),
    tidy_sql(_numeric_sql("orders", _NUMBERS), "numeric_stats", _SPREAD, _COLUMN),
    tidy_sql(_outlier_sql("orders", _NUMBERS, "+"), "outliers", ["iqr", "outliers_low", "outliers_high", "outliers_pct"], _COLUMN),
    _named(_pairs_sql("orders", _NUMBERS, "abs_corr", "round(abs(corr({a}, {b})), 6)", ""), "pearson_corr_top", "col_a", "'abs_corr'", "abs_corr", "col_b"),
    _named(_categories_sql("orders", ["o_orderstatus", "o_orderpriority"], 30), "categorical_stats", _COLUMN, "'top_value'", "n", "value"),
    tidy_sql(_FILLED, "missingness_summary", ["rows", "missing", "missing_pct"], _COLUMN),
    tidy_sql(f"SELECT count(*) AS rows, count(*) FILTER ({_ANY_MISSING}) AS rows_with_any_missing, count(*) FILTER ({_ANY_MISSING}) * 100.0::DOUBLE / count(*) AS rows_with_any_missing_pct FROM orders",
             "rows_with_missing", ["rows", "rows_with_any_missing", "rows_with_any_missing_pct"]),
    _named(_TARGET, "target_preview", "NULL", "metric", "value", "key")]))
def table_report(spark, sf_dir):
    return rounded(R.table_report(table(spark, sf_dir, "orders"), "o_orderstatus"))


_LABELLED = "(SELECT d.*, quality FROM documents d LEFT JOIN labels USING (doc_id))"


@query("text_report", union_sql([
    tidy_sql("""SELECT count(*) AS rows, count(*) - count(text) AS missing_text, count(*) FILTER (text = '') AS empty_text,
  count(*) FILTER (regexp_full_match(text, '[\\s\\p{Z}]*')) AS whitespace_only FROM documents""", "counts", ["rows", "missing_text", "empty_text", "whitespace_only"]),
    tidy_sql(ORACLES["text_length_profile"], "lengths", ["count", "mean", "std", "min", "p50", "p90", "p99", "max"], _COLUMN),
    tidy_sql(ORACLES["vocabulary_size"], "token_stats", ["vocab_estimate"]),
    _named(ORACLES["top_unigrams"], "token_stats", "NULL", "'top_unigram'", "count", "token"),
    _named(ORACLES["top_bigrams"], "token_stats", "NULL", "'top_bigram'", "count", "token"),
    _named(ORACLES["label_preview"], "label_preview", "NULL", "metric", "value", "key"),
    tidy_sql(ORACLES["label_text_lengths"], "per_label_text_len", ["mean_chars", "mean_words"], "label"),
    tidy_sql(_repeated(_LABELLED).replace("count(*) AS n FROM", "*, count(*) AS n FROM"), "duplicates", ["rows", "duplicate_rows", "duplicate_rows_pct"]),
    tidy_sql(ORACLES["duplicate_texts"], "duplicates", ["duplicate_texts"]),
    _named(ORACLES["top_duplicate_texts"], "duplicates", "NULL", "'top_duplicate_text'", "count", "text"),
    tidy_sql(ORACLES["char_makeup"], "char_composition", ["digits_pct_mean", "punct_pct_mean", "upper_pct_mean"])]))
def text_report(spark, sf_dir):
    return rounded(R.text_report(labelled(spark, sf_dir), "text", "quality"))


@query("model_card")
def model_card(spark, sf_dir):
    board, train, test = _board(spark, sf_dir, boosted=False)
    return R.model_card(train, test, "industrial", board.table, board.best)

"""Table profile and data quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .registry import query, rounded, table, union_sql

LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PROBS = [(0.01, "p1"), (0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99")]

LINEITEM_GAPS = """(SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  l_discount FROM lineitem)"""

CUSTOMER_GAPS = """(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  nullif(c_nationkey, 7) AS c_nationkey FROM customer)"""


def lineitem_gaps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount",
    )


def customer_gaps(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_nationkey", F.lit(7)).alias("c_nationkey"),
    )


def _numeric_sql(source: str, cols: list[str]) -> str:
    return union_sql([
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct,
  round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,
  round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max,
  {', '.join(f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS {n}" for p, n in PROBS)} FROM {source}"""
        for c in cols
    ])


@query("numeric_profile", _numeric_sql("lineitem", LINEITEM_NUMBERS))
def numeric_profile(spark, sf_dir):
    return rounded(P.numeric_profile(table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS))


@query("numeric_profile_nulls", _numeric_sql(LINEITEM_GAPS, ["l_quantity", "l_extendedprice", "l_discount"]))
def numeric_profile_nulls(spark, sf_dir):
    return rounded(P.numeric_profile(lineitem_gaps(spark, sf_dir)))


ORDERS_CLASSES = {
    "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "object", "o_totalprice": "float",
    "o_orderdate": "datetime64", "o_orderpriority": "object",
}


@query("table_shape", "SELECT count(*) AS rows, 6::BIGINT AS cols FROM orders")
def table_shape(spark, sf_dir):
    return P.table_shape(table(spark, sf_dir, "orders"))


@query("column_types", union_sql([
    f"""SELECT '{c}' AS "column", '{k}' AS dtype, count({c}) AS non_null FROM orders""" for c, k in ORDERS_CLASSES.items()
]))
def column_types(spark, sf_dir):
    return P.column_types(table(spark, sf_dir, "orders"))


@query("schema_summary", union_sql([
    f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS nunique,
  count(DISTINCT {c}) > greatest(50, floor(0.2 * count(*))) AS high_cardinality FROM orders"""
    for c, k in ORDERS_CLASSES.items()
]))
def schema_summary(spark, sf_dir):
    return P.schema_summary(table(spark, sf_dir, "orders"))


@query("high_cardinality", "SELECT * FROM (" + union_sql([
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS nunique FROM orders
  HAVING count(DISTINCT {c}) > greatest(50, floor(0.2 * count(*)))""" for c in ORDERS_CLASSES
]) + ")")
def high_cardinality(spark, sf_dir):
    return P.high_cardinality(table(spark, sf_dir, "orders"))


@query("memory_summary", """
WITH b AS (SELECT count(o_orderkey) * 8 AS a1, count(o_custkey) * 8 AS a2,
  sum(strlen(o_orderstatus))::BIGINT AS a3, count(o_totalprice) * 8 AS a4, count(o_orderdate) * 8 AS a5,
  sum(strlen(o_orderpriority))::BIGINT AS a6 FROM orders)
SELECT 'o_orderkey' AS "column", a1::BIGINT AS bytes FROM b UNION ALL SELECT 'o_custkey', a2 FROM b
UNION ALL SELECT 'o_orderstatus', a3 FROM b UNION ALL SELECT 'o_totalprice', a4 FROM b
UNION ALL SELECT 'o_orderdate', a5 FROM b UNION ALL SELECT 'o_orderpriority', a6 FROM b
UNION ALL SELECT '(total)', (a1 + a2 + a3 + a4 + a5 + a6)::BIGINT FROM b""")
def memory_summary(spark, sf_dir):
    return P.memory_summary(table(spark, sf_dir, "orders"))


@query("duplicate_rows", """
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag, l_linestatus)
SELECT sum(n)::BIGINT AS rows, (sum(n) - count(*))::BIGINT AS duplicate_rows,
  round((sum(n) - count(*)) * 100.0::DOUBLE / sum(n), 6) AS duplicate_rows_pct FROM g""")
def duplicate_rows(spark, sf_dir):
    return rounded(P.duplicate_summary(
        table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    ))


@query("duplicate_rows_long_text", """
WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang)
SELECT sum(n)::BIGINT AS rows, (sum(n) - count(*))::BIGINT AS duplicate_rows,
  round((sum(n) - count(*)) * 100.0::DOUBLE / sum(n), 6) AS duplicate_rows_pct FROM g""")
def duplicate_rows_long_text(spark, sf_dir):
    return rounded(P.duplicate_summary(table(spark, sf_dir, "documents").select("text", "lang")))


def _iso(e: str) -> str:
    return f"replace(strftime({e}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')"


@query("datetime_ranges", f"""
SELECT 'ts' AS "column", {_iso('min(ts)')} AS min, {_iso('max(ts)')} AS max FROM events""")
def datetime_ranges(spark, sf_dir):
    return P.datetime_overview(table(spark, sf_dir, "events"))


def _outlier_sql(source: str, cols: list[str], sign: str) -> str:
    return union_sql([
        f"""(WITH q AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source})
SELECT '{c}' AS "column", round(max(q3 - q1), 6) AS iqr, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS outliers_low,
  count(*) FILTER ({c} > q3 {sign} 1.5 * (q3 - q1)) AS outliers_high,
  round((count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) + count(*) FILTER ({c} > q3 {sign} 1.5 * (q3 - q1)))
    * 100.0::DOUBLE / count({c}), 6) AS outliers_pct FROM {source}, q)""" for c in cols
    ])


@query("iqr_outliers", _outlier_sql("part", ["p_size", "p_retailprice"], "+"))
def iqr_outliers(spark, sf_dir):
    return rounded(P.iqr_outliers(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@query("iqr_outliers_reference", _outlier_sql("orders", ["o_totalprice"], "-"))
def iqr_outliers_reference(spark, sf_dir):
    return rounded(P.iqr_outliers(table(spark, sf_dir, "orders"), ["o_totalprice"], fence="reference"))


def _pairs_sql(source: str, cols: list[str], head: str, value: str, tail: str) -> str:
    return f"SELECT * FROM (" + union_sql([
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {value.format(a=a, b=b)} AS {head} FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:]
    ]) + f") WHERE {head} IS NOT NULL AND NOT isnan({head}) {tail}"


LINEITEM_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + LINEITEM_NUMBERS


@query("correlation_pairs", _pairs_sql("lineitem", LINEITEM_ALL, "abs_corr", "round(abs(corr({a}, {b})), 6)",
                                       "ORDER BY abs_corr DESC, col_a, col_b LIMIT 20"))
def correlation_pairs(spark, sf_dir):
    return rounded(P.correlation_pairs(table(spark, sf_dir, "lineitem")))


@query("correlation_nulls", _pairs_sql(LINEITEM_GAPS, ["l_quantity", "l_extendedprice", "l_discount"], "abs_corr",
                                       "round(abs(corr({a}, {b})), 6)", "ORDER BY abs_corr DESC, col_a, col_b LIMIT 20"))
def correlation_nulls(spark, sf_dir):
    return rounded(P.correlation_pairs(lineitem_gaps(spark, sf_dir)))


def _categories_sql(source: str, cols: list[str], k: int) -> str:
    return union_sql([
        f"""(WITH f AS (SELECT {c} AS v, count(*) AS n FROM {source} GROUP BY 1),
r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v NULLS LAST)::INTEGER AS rank, count(v) OVER () AS nunique FROM f)
SELECT '{c}' AS "column", nunique, rank, coalesce(v, 'NaN') AS value, n FROM r WHERE rank <= {k})""" for c in cols
    ])


@query("categorical_top_values", _categories_sql(CUSTOMER_GAPS, ["c_mktsegment"], 30))
def categorical_top_values(spark, sf_dir):
    return P.categorical_profile(customer_gaps(spark, sf_dir))


@query("categorical_top_values_long_ties", _categories_sql("(SELECT repeat('long text ', 8) || text AS text FROM documents)", ["text"], 20))
def categorical_top_values_long_ties(spark, sf_dir):
    """Values of which nearly all are long, begin alike and occur once."""
    return P.categorical_profile(table(spark, sf_dir, "documents").select(F.concat(F.lit("long text " * 8), "text").alias("text")), k=20)


@query("categorical_top_values_orders", _categories_sql("orders", ["o_orderstatus", "o_orderpriority"], 3))
def categorical_top_values_orders(spark, sf_dir):
    return P.categorical_profile(table(spark, sf_dir, "orders"), k=3)


@query("missingness", union_sql([
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM {CUSTOMER_GAPS}"""
    for c in ["c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"]
]))
def missingness(spark, sf_dir):
    return rounded(P.missingness(customer_gaps(spark, sf_dir)))


_ANY = "c_custkey IS NULL OR c_mktsegment IS NULL OR c_acctbal IS NULL OR c_nationkey IS NULL"


@query("missing_any_rows", f"""
SELECT count(*) AS rows, count(*) FILTER ({_ANY}) AS rows_with_any_missing,
  round(count(*) FILTER ({_ANY}) * 100.0::DOUBLE / count(*), 6) AS rows_with_any_missing_pct FROM {CUSTOMER_GAPS}""")
def missing_any_rows(spark, sf_dir):
    return rounded(P.rows_with_missing(customer_gaps(spark, sf_dir)))


@query("row_missing_counts", f"""
SELECT c_custkey, (c_mktsegment IS NULL)::INTEGER + (c_acctbal IS NULL)::INTEGER + (c_nationkey IS NULL)::INTEGER AS missing
FROM {CUSTOMER_GAPS} ORDER BY c_custkey LIMIT 200""")
def row_missing_counts(spark, sf_dir):
    return P.row_missing_counts(customer_gaps(spark, sf_dir), ["c_custkey"])


@query("missing_matrix", f"""
SELECT 0::INTEGER AS c_custkey, (c_mktsegment IS NULL)::INTEGER AS c_mktsegment, (c_acctbal IS NULL)::INTEGER AS c_acctbal,
  (c_nationkey IS NULL)::INTEGER AS c_nationkey
FROM (SELECT *, c_custkey AS k FROM {CUSTOMER_GAPS}) ORDER BY k LIMIT 200""")
def missing_matrix(spark, sf_dir):
    return P.missing_matrix(customer_gaps(spark, sf_dir), ["c_custkey"])


@query("nullity_correlation", _pairs_sql(CUSTOMER_GAPS, ["c_mktsegment", "c_acctbal", "c_nationkey"], "corr",
                                         "round(corr(({a} IS NULL)::INTEGER, ({b} IS NULL)::INTEGER), 6)", ""))
def nullity_correlation(spark, sf_dir):
    return rounded(P.nullity_correlation(customer_gaps(spark, sf_dir)))


@query("describe_sample_std", union_sql([
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c})::DOUBLE, 6) AS min, {', '.join(f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS {n}" for p, n in PROBS[2:5])},
  round(max({c})::DOUBLE, 6) AS max FROM events""" for c in ["user_id", "value"]
]))
def describe_sample_std(spark, sf_dir):
    return rounded(P.describe(table(spark, sf_dir, "events"), ["user_id", "value"]))


_REGRESSION = [("count", "count(o_totalprice)::DOUBLE"), ("mean", "round(avg(o_totalprice), 6)"),
               ("std", "round(stddev_pop(o_totalprice), 6)")] + [
    (n, f"round(quantile_cont(o_totalprice, {p}), 6)") for p, n in [(0.05, "p5"), (0.5, "p50"), (0.95, "p95")]]


@query("target_regression", union_sql([
    f"SELECT '{m}' AS metric, NULL::VARCHAR AS key, {e} AS value FROM orders" for m, e in _REGRESSION
]))
def target_regression(spark, sf_dir):
    return rounded(P.target_preview(table(spark, sf_dir, "orders"), "o_totalprice"))


@query("target_classification", f"""
WITH f AS (SELECT c_mktsegment AS v, count(*) AS n FROM {CUSTOMER_GAPS} GROUP BY 1)
SELECT 'n_classes' AS metric, NULL::VARCHAR AS key, count(v)::DOUBLE AS value FROM f
UNION ALL SELECT 'imbalance_ratio', NULL, round(max(n)::DOUBLE / min(n), 6) FROM f
UNION ALL SELECT * FROM (SELECT 'class_count', coalesce(v, 'NaN'), n::DOUBLE FROM f ORDER BY n DESC, v NULLS LAST LIMIT 50)""")
def target_classification(spark, sf_dir):
    return rounded(P.target_preview(customer_gaps(spark, sf_dir), "c_mktsegment"))

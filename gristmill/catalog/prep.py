"""Combining, checking, splitting and preparing tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import prep as P
from ..operators import quality as Q
from ..operators import split as S
from .registry import query, rounded, table, union_sql
from .tables import CUSTOMER_GAPS, customer_gaps

# --- combining and checking --------------------------------------------------


@query("union_tables", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey::VARCHAR FROM supplier""")
def union_tables(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return Q.concat_tables([
        c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                 F.col("c_mktsegment").alias("segment")),
        s.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                 F.col("s_nationkey").cast("string").alias("nation")),
    ])


@query("select_number_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_number_columns(spark, sf_dir):
    return Q.select_types(table(spark, sf_dir, "part"), "number")


@query("drop_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def drop_columns(spark, sf_dir):
    return Q.drop_columns(table(spark, sf_dir, "part"), "p_name", "p_type", "p_retailprice")


@query("drop_missing", f"SELECT * FROM {CUSTOMER_GAPS} WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL")
def drop_missing(spark, sf_dir):
    return Q.drop_missing(customer_gaps(spark, sf_dir), ["c_mktsegment", "c_acctbal"])


@query("fill_missing_text", f"SELECT c_custkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM {CUSTOMER_GAPS}")
def fill_missing_text(spark, sf_dir):
    return Q.fill_text(customer_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("cast_to_text", f"""
SELECT c_custkey, coalesce(c_mktsegment, 'nan') AS c_mktsegment, coalesce(c_nationkey::VARCHAR, 'nan') AS c_nationkey FROM {CUSTOMER_GAPS}""")
def cast_to_text(spark, sf_dir):
    return Q.as_text(customer_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment", "c_nationkey"),
                     ["c_mktsegment", "c_nationkey"], "nan")


@query("derived_columns", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, l_quantity > 25 AS bulk FROM lineitem")
def derived_columns(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    out = Q.add_columns(base, {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6), "bulk": F.col("l_quantity") > 25})
    return out.select("l_orderkey", "l_linenumber", "net", "bulk")


@query("top_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_rows(spark, sf_dir):
    return Q.top_rows(table(spark, sf_dir, "orders"), "o_totalprice", 10, ["o_orderkey"])


@query("first_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def first_rows(spark, sf_dir):
    return Q.first_rows(table(spark, sf_dir, "customer"), ["c_custkey"])


_JSON = """'{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}'"""


@query("table_preview", f"""
SELECT * FROM (SELECT 'head' AS part, {_JSON} AS row FROM nation ORDER BY n_nationkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'tail', {_JSON} FROM nation ORDER BY n_nationkey DESC LIMIT 5)""")
def table_preview(spark, sf_dir):
    return Q.table_preview(table(spark, sf_dir, "nation"), ["n_nationkey"])


@query("type_inference", """
SELECT o_orderkey, CASE WHEN regexp_full_match(a, '-?[0-9]+(\\.[0-9]+)?') THEN a::DOUBLE END AS price, d::TIMESTAMP AS day, o_orderpriority, mixed
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS a,
  strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority,
  CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_custkey::VARCHAR END AS mixed FROM orders)""")
def type_inference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    texts = o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority",
        F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
    )
    out = Q.infer_and_coerce(texts)
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("range_check", union_sql([
    """SELECT 'l_discount' AS "column", 0.02::DOUBLE AS min, 0.07::DOUBLE AS max, count(*) AS n_total,
  count(*) FILTER (l_discount BETWEEN 0.02 AND 0.07) AS n_within FROM lineitem""",
    "SELECT 'l_returnflag', 0, 1, count(*), NULL FROM lineitem"]))
def range_check(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return Q.range_check(df, "l_discount", 0.02, 0.07).unionByName(Q.range_check(df, "l_returnflag", 0, 1))


_RULES = [
    ("c_mktsegment", "not_null", {}, "c_mktsegment IS NOT NULL"),
    ("c_acctbal", "range", {"low": 100, "high": 5000}, "c_acctbal IS NULL OR c_acctbal BETWEEN 100 AND 5000"),
    ("c_mktsegment", "in_set", {"values": ["MACHINERY", "AUTOMOBILE"]}, "c_mktsegment IS NULL OR c_mktsegment IN ('MACHINERY', 'AUTOMOBILE')"),
    ("c_mktsegment", "regex", {"pattern": "^[A-M]"}, "c_mktsegment IS NULL OR regexp_matches(c_mktsegment, '^[A-M]')"),
]


@query("type_inference_written_forms", """
SELECT o_orderkey, CASE o_orderkey % 30 WHEN 0 THEN 100000.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE ELSE o_orderkey::DOUBLE END AS n,
  strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS d FROM orders""")
def type_inference_written_forms(spark, sf_dir):
    """Numbers and dates in several written forms."""
    day = lambda f: F.date_format("o_orderdate", f)
    kind = F.col("o_orderkey") % 3
    forms = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 30 == 0, " 1e5").when(F.col("o_orderkey") % 30 == 1, "+3").otherwise(F.col("o_orderkey").cast("string")).alias("n"),
        F.when(kind == 0, day("M/d/yyyy")).when(kind == 1, day("MMM d, yyyy")).otherwise(day("yyyy-MM-dd")).alias("d"),
    )
    return Q.infer_and_coerce(forms).withColumn("d", F.col("d").cast("timestamp_ntz"))


@query("validation_rules", union_sql([
    f"""SELECT '{c}' AS "column", '{k}' AS rule, count(*) AS n_total, count(*) FILTER ({e}) AS n_passed,
  round(count(*) FILTER ({e}) * 100.0::DOUBLE / count(*), 6) AS pct_passed FROM {CUSTOMER_GAPS}""" for c, k, _, e in _RULES
] + [f"""SELECT c AS "column", 'unique', sum(n)::BIGINT, sum(CASE WHEN n = 1 OR v IS NULL THEN n ELSE 0 END)::BIGINT,
  round(sum(CASE WHEN n = 1 OR v IS NULL THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n), 6)
  FROM (SELECT '{c}' AS c, {c} AS v, count(*) AS n FROM {CUSTOMER_GAPS} GROUP BY {c}) GROUP BY c""" for c in ("c_custkey", "c_acctbal")]))
def validation_rules(spark, sf_dir):
    rules = [Q.Rule(c, k, a) for c, k, a, _ in _RULES] + [Q.Rule("c_custkey", "unique"), Q.Rule("c_acctbal", "unique")]
    return rounded(Q.validate(customer_gaps(spark, sf_dir), rules))


# --- splits ------------------------------------------------------------------

_HASH = "md5('42' || chr(1) || o_orderkey::VARCHAR)"


@query("split_random", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_HASH}) <= ceil((SELECT count(*) FROM orders) * 0.2::DOUBLE)
  THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_random(spark, sf_dir):
    return S.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.2)


@query("split_stratified", f"""
SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HASH})
  <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_stratified(spark, sf_dir):
    return S.random_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 0.2, stratify="o_orderstatus")


@query("sample_rows", f"SELECT * FROM orders ORDER BY {_HASH} LIMIT 1000")
def sample_rows(spark, sf_dir):
    return S.sample_rows(table(spark, sf_dir, "orders"), 1000, ["o_orderkey"])


# --- imputing and scaling ----------------------------------------------------

_IMPUTED = ["c_acctbal", "c_nationkey"]


def _impute_sql(fill: dict[str, str]) -> str:
    return f"""SELECT c_custkey, {', '.join(f"round(coalesce({c}::DOUBLE, {e}), 6) AS {c}" for c, e in fill.items())} FROM {CUSTOMER_GAPS}"""


def _impute(spark, sf_dir, strategy):
    df = customer_gaps(spark, sf_dir).drop("c_mktsegment")
    return rounded(P.ImputeNumbers(_IMPUTED, strategy).fit(df).transform(df))


@query("impute_mean", _impute_sql({c: f"(SELECT avg({c}) FROM {CUSTOMER_GAPS})" for c in _IMPUTED}))
def impute_mean(spark, sf_dir):
    return _impute(spark, sf_dir, "mean")


@query("impute_median", _impute_sql({c: f"(SELECT quantile_cont({c}::DOUBLE, 0.5) FROM {CUSTOMER_GAPS})" for c in _IMPUTED}))
def impute_median(spark, sf_dir):
    return _impute(spark, sf_dir, "median")


@query("impute_most_frequent", _impute_sql({
    c: f"(SELECT {c} FROM {CUSTOMER_GAPS} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in _IMPUTED}))
def impute_most_frequent(spark, sf_dir):
    return _impute(spark, sf_dir, "most_frequent")


@query("impute_constant", _impute_sql({c: "0" for c in _IMPUTED}))
def impute_constant(spark, sf_dir):
    return _impute(spark, sf_dir, "constant")


@query("impute_categories", f"""
SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM {CUSTOMER_GAPS} WHERE c_mktsegment IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM {CUSTOMER_GAPS}""")
def impute_categories(spark, sf_dir):
    df = customer_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment")
    return P.ImputeCategories(["c_mktsegment"]).fit(df).transform(df)


@query("impute_categories_constant", f"SELECT c_custkey, coalesce(c_mktsegment, '__MISSING__') AS c_mktsegment FROM {CUSTOMER_GAPS}")
def impute_categories_constant(spark, sf_dir):
    df = customer_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment")
    return P.ImputeCategories(["c_mktsegment"], "constant").fit(df).transform(df)


_SCALED = ["p_size", "p_retailprice", "flat"]
PART_FLAT = "(SELECT p_partkey, p_size, p_retailprice, 3 AS flat FROM part)"


def _scale_sql(center: str, spread: str) -> str:
    return f"""WITH s AS (SELECT {', '.join(f"({center.format(c=c)})::DOUBLE AS a_{c}, ({spread.format(c=c)})::DOUBLE AS b_{c}" for c in _SCALED)} FROM {PART_FLAT})
SELECT p_partkey, {', '.join(f"round(({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END, 6) AS {c}" for c in _SCALED)} FROM {PART_FLAT}, s"""


def _scale(spark, sf_dir, method):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(3).alias("flat"))
    return rounded(P.Scale(_SCALED, method).fit(df).transform(df))


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _scale(spark, sf_dir, "standard")


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf_dir):
    return _scale(spark, sf_dir, "minmax")


@query("scale_robust", _scale_sql("quantile_cont({c}::DOUBLE, 0.5)", "quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)"))
def scale_robust(spark, sf_dir):
    return _scale(spark, sf_dir, "robust")


# --- encoding ----------------------------------------------------------------


@query("label_encode", f"""
SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS c_mktsegment FROM {CUSTOMER_GAPS}""")
def label_encode(spark, sf_dir):
    return P.label_encode(customer_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("label_encode_names", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer")
def label_encode_names(spark, sf_dir):
    return P.label_encode(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"])


@query("one_hot", f"""SELECT c_custkey, {', '.join(f"coalesce(c_mktsegment = '{v}', false) AS c_mktsegment_{v}"
    for v in ['AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])} FROM {CUSTOMER_GAPS}""")
def one_hot(spark, sf_dir):
    return P.one_hot(customer_gaps(spark, sf_dir).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


def _vector_query(df, **options):
    model = P.OneHotVector(["v"], **options).fit(df)
    return model.transform(df).select("key", vector_to_array("v_vec").alias("vec"))


@query("one_hot_vector", f"""SELECT c_custkey AS key, [{', '.join(f"coalesce(c_mktsegment = '{v}', false)::INTEGER::DOUBLE"
    for v in ['AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])}] AS vec FROM {CUSTOMER_GAPS}""")
def one_hot_vector(spark, sf_dir):
    df = customer_gaps(spark, sf_dir).select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("v"))
    return _vector_query(df)


@query("one_hot_drop_first", f"""SELECT c_custkey AS key, [{', '.join(f"coalesce(c_mktsegment = '{v}', false)::INTEGER::DOUBLE"
    for v in ['FURNITURE', 'HOUSEHOLD', 'MACHINERY'])}] AS vec FROM {CUSTOMER_GAPS}""")
def one_hot_drop_first(spark, sf_dir):
    df = customer_gaps(spark, sf_dir).select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("v"))
    return _vector_query(df, drop="first")


@query("one_hot_capped", """
WITH f AS (SELECT p_type AS v, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_type),
k AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM f WHERE r <= 3),
x AS (SELECT p_partkey AS key, coalesce(i, 4) AS i FROM part LEFT JOIN k ON p_type = v)
SELECT key, list_transform(range(1, 5), lambda j: (j = i)::INTEGER::DOUBLE) AS vec FROM x""")
def one_hot_capped(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("v"))
    return _vector_query(df, max_categories=4)


@query("polynomial_terms", """
SELECT p_size::DOUBLE AS p_size, p_retailprice, p_size * p_size::DOUBLE AS "p_size^2", round(p_size * p_retailprice, 6) AS "p_size p_retailprice",
  round(p_retailprice * p_retailprice, 6) AS "p_retailprice^2", p_partkey FROM part""")
def polynomial_terms(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(P.polynomial_stage(["p_size", "p_retailprice"]).transform(df))


@query("pca")
def pca(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return P.PrincipalComponents(["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 2).fit(df).transform(df)


@query("prepare_interactive", f"""
WITH m AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM {CUSTOMER_GAPS})) AS c_acctbal,
  dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS c_mktsegment FROM {CUSTOMER_GAPS}),
s AS (SELECT {', '.join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in ['c_custkey', 'c_acctbal', 'c_mktsegment'])} FROM m)
SELECT {', '.join(f"round(({c} - a_{c}) / b_{c}, 6) AS {c}" for c in ['c_custkey', 'c_acctbal', 'c_mktsegment'])} FROM m, s""")
def prepare_interactive(spark, sf_dir):
    df = customer_gaps(spark, sf_dir).select("c_custkey", "c_acctbal", "c_mktsegment")
    return rounded(P.prepare(df, missing="median", encoding="label", scaling="standard"))


_SEGMENTS = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("preprocessor_baseline", f"""
WITH m AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM {CUSTOMER_GAPS})) AS b,
  coalesce(c_mktsegment, (SELECT c_mktsegment FROM {CUSTOMER_GAPS} WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS g
  FROM {CUSTOMER_GAPS}), s AS (SELECT avg(b) AS a, stddev_pop(b) AS d FROM m)
SELECT c_custkey, round((b - a) / d, 6) AS f0, {', '.join(f"(g = '{v}')::INTEGER::DOUBLE AS f{i + 1}" for i, v in enumerate(_SEGMENTS))} FROM m, s""")
def preprocessor_baseline(spark, sf_dir):
    df = customer_gaps(spark, sf_dir)
    pipeline, _, _ = P.build_preprocessor(df, P.make_config(numeric_cols=("c_acctbal",), categorical_cols=("c_mktsegment",)))
    out = pipeline.fit(df).transform(df).withColumn("a", vector_to_array("features"))
    return rounded(out.select("c_custkey", *[F.get("a", F.lit(i)).alias(f"f{i}") for i in range(5)]))

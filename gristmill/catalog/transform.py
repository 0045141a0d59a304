"""Power transform, bins, variance threshold and ordinals in a given order."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..core import new_path
from ..operators import prep as P
from ..operators import transform as X
from .registry import query, rounded, table, union_sql
from .tables import CUSTOMER_GAPS, customer_gaps

# --- power transform ---------------------------------------------------------

# Every exponent in steps of a hundredth; the one of the greatest likelihood.
_LIKELIHOOD = """SELECT '{c}' AS "column", '{m}' AS method, arg_max(e, l) AS exponent FROM (
  SELECT e, -count(v) / 2.0::DOUBLE * ln(var_pop(v)) + (e - 1) * sum(s) AS l FROM (
    SELECT e, {slope} AS s, {power} AS v FROM (SELECT ({x})::DOUBLE AS x FROM {t}) AS r, (SELECT i / 100.0::DOUBLE AS e FROM range(-500, 501) AS g(i)))
  GROUP BY e HAVING var_pop(v) > 0)"""
_YEO = ("sign(x) * ln(1 + abs(x))", """CASE WHEN x >= 0 THEN CASE WHEN e = 0 THEN ln(1 + x) ELSE (pow(x + 1, e) - 1) / e END
  WHEN x < 0 THEN CASE WHEN e = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - e) - 1) / (2 - e) END END""")
_BOX = ("CASE WHEN x > 0 THEN ln(x) END", "CASE WHEN x > 0 THEN CASE WHEN e = 0 THEN ln(x) ELSE (pow(x, e) - 1) / e END END")


def skewed(spark, sf_dir):
    """Skewed numbers: squares of sizes, balances of both signs, and prices."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * F.col("p_size")).cast("double").alias("square"), (F.exp(F.col("p_size") / 10) - 20).alias("grown"))


_SKEWED = "(SELECT p_partkey, p_size * p_size AS square, exp(p_size / 10.0::DOUBLE) - 20 AS grown FROM part)"


@query("power_exponents", union_sql([
    _LIKELIHOOD.format(c="square", x="square", m="yeo_johnson", slope=_YEO[0], power=_YEO[1], t=_SKEWED),
    _LIKELIHOOD.format(c="grown", x="grown", m="yeo_johnson", slope=_YEO[0], power=_YEO[1], t=_SKEWED),
    _LIKELIHOOD.format(c="square", x="square", m="box_cox", slope=_BOX[0], power=_BOX[1], t=_SKEWED)]))
def power_exponents(spark, sf_dir):
    df = skewed(spark, sf_dir)
    rows = [(c, m, e) for m, cols in (("yeo_johnson", ["square", "grown"]), ("box_cox", ["square"])) for c, e in X.PowerTransform(cols, m).exponents(df).items()]
    return rounded(spark.createDataFrame(rows, "column string, method string, exponent double"), 2)


@query("power_transform", union_sql([f"""SELECT '{c}' AS "column", count(*) AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std, true AS in_order FROM part""" for c in ("square", "grown")]))
def power_transform(spark, sf_dir):
    """Transformed columns after the model was saved and loaded: mean 0, deviation 1, the order kept."""
    df = skewed(spark, sf_dir)
    path = new_path(spark, "power")
    P.save_pipeline(PipelineModel([X.PowerTransform(["square", "grown"]).fit(df)]), path)
    both = P.load_pipeline(path).transform(df).join(df.select("p_partkey", F.col("square").alias("a"), F.col("grown").alias("b")), "p_partkey")
    out = both.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("square", "grown") for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
                   *[(F.corr(c, o) > 0).alias(f"up_{c}") for c, o in (("square", "a"), ("grown", "b"))])
    parts = [F.struct(F.lit(c).alias("column"), "n", F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"), F.col(f"up_{c}").alias("in_order")) for c in ("square", "grown")]
    return rounded(out.select(F.inline(F.array(*parts))))


# --- bins --------------------------------------------------------------------


def _bins_sql(edges: dict[str, list[str]]) -> str:
    made = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN {' + '.join(f'({c} >= {e})::INTEGER' for e in es)} END::INTEGER AS {c}""" for c, es in edges.items())
    return f"SELECT c_custkey, {made} FROM {CUSTOMER_GAPS}, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey)::DOUBLE AS nlo, max(c_nationkey)::DOUBLE AS nhi FROM {CUSTOMER_GAPS})"


def _bins(spark, sf_dir, **options):
    df = customer_gaps(spark, sf_dir).select("c_custkey", "c_acctbal", "c_nationkey")
    return X.KBins(["c_acctbal", "c_nationkey"], **options).fit(df).transform(df)


@query("bins_equal_width", _bins_sql({"c_acctbal": [f"lo + (hi - lo) * {i} / 7" for i in range(1, 7)], "c_nationkey": [f"nlo + (nhi - nlo) * {i} / 7" for i in range(1, 7)]}))
def bins_equal_width(spark, sf_dir):
    return _bins(spark, sf_dir, k=7, strategy="uniform")


_QUARTERS = f"SELECT {', '.join(f'quantile_cont({c}::DOUBLE, {p}) AS {c}_{i}' for c in ('c_acctbal', 'c_nationkey') for i, p in enumerate((0.25, 0.5, 0.75)))} FROM {CUSTOMER_GAPS}"


@query("bins_equal_count", f"""SELECT c_custkey, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN {' + '.join(f'({c} >= {c}_{i})::INTEGER' for i in range(3))} END::INTEGER AS {c}" for c in ('c_acctbal', 'c_nationkey'))}
FROM {CUSTOMER_GAPS}, ({_QUARTERS})""")
def bins_equal_count(spark, sf_dir):
    return _bins(spark, sf_dir, k=4, strategy="quantile")


@query("bins_one_hot", f"""SELECT c_custkey, c_nationkey, [{', '.join(f"coalesce(c_acctbal >= {a} AND c_acctbal < {b}, false)::INTEGER::DOUBLE" for a, b in (('-1', 'm'), ('m', '1e9')))}] AS vec
FROM {CUSTOMER_GAPS}, (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM {CUSTOMER_GAPS})""")
def bins_one_hot(spark, sf_dir):
    df = customer_gaps(spark, sf_dir).select("c_custkey", "c_acctbal", "c_nationkey")
    out = X.KBins(["c_acctbal"], k=2, encode="one_hot").fit(df).transform(df)
    return out.select("c_custkey", "c_nationkey", vector_to_array("c_acctbal_bins").alias("vec"))


@query("bins_by_means")
def bins_by_means(spark, sf_dir):
    return _bins(spark, sf_dir, k=4, strategy="kmeans")


# --- variance and order ------------------------------------------------------

_MEASURED = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "flat"]


@query("variance_kept", union_sql([f"""SELECT '{c}' AS "column", round(var_pop({c}), 6) AS variance, var_pop({c}) > 0.0009 AS kept FROM (SELECT *, 3 AS flat FROM lineitem)""" for c in _MEASURED]))
def variance_kept(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("flat", F.lit(3))
    model = X.VarianceThreshold(_MEASURED, 0.0009)
    kept = set(model.kept(df))
    return rounded(spark.createDataFrame([(c, v, c in kept) for c, v in model.variances(df).items()], "column string, variance double, kept boolean"))


@query("variance_threshold", "SELECT p_partkey, p_size, p_retailprice FROM part")
def variance_threshold(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(3).alias("flat"), "p_retailprice", F.lit(None).cast("double").alias("none"))
    return X.VarianceThreshold(["p_size", "flat", "p_retailprice", "none"]).fit(df).transform(df)


_ORDER = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("ordinal_given_order", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL {' '.join(f"WHEN o_orderpriority = '{v}' THEN {i}" for i, v in enumerate(_ORDER))} ELSE -1 END::INTEGER AS o_orderpriority FROM orders""")
def ordinal_given_order(spark, sf_dir):
    """Priorities from low to urgent; one that is not in the order is unknown."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return X.OrdinalEncode({"o_orderpriority": _ORDER}).fit(df).transform(df)

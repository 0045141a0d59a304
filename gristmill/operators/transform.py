"""Further numeric and ordered preparation: power transform, k bins, variance threshold, ordinals in a given order.

As in `prep`, a fit is an aggregate and the fitted stage a SQL projection of literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import chunks, clean_nan, col, dealt, quoted
from .prep import category_sql, double_sql, number_sql, replacing, text_sql
from .quantiles import exact_quantiles

#: Exponents are looked for between these; each step looks at so many, and narrows the range to two gaps of them.
EXPONENTS = (-5.0, 5.0)
CANDIDATES = 17
STEPS = 8
#: Aggregates of one job: columns are searched together up to this many.
PER_JOB = 400
#: Rows of a task in the search for exponents, where a file's splits hold more.
ROWS_PER_TASK = 50_000
#: Rounds after which one-dimensional k-means stops moving its centres.
KMEANS_ROUNDS = 100


# --- power transform ---------------------------------------------------------


def power_sql(x: str, exponent: float, method: str) -> str:
    """The transform with one exponent. box_cox: NULL for numbers not above 0."""
    if method == "box_cox":
        if exponent == 0.0:
            return f"CASE WHEN {x} > 0 THEN ln({x}) END"
        e = number_sql(exponent)
        return f"CASE WHEN {x} > 0 THEN (pow({x}, {e}) - 1) / {e} END"
    up = f"log1p({x})" if exponent == 0.0 else f"(pow({x} + 1, {number_sql(exponent)}) - 1) / {number_sql(exponent)}"
    rest = 2.0 - exponent
    down = f"-log1p(-({x}))" if rest == 0.0 else f"-(pow(1 - ({x}), {number_sql(rest)}) - 1) / {number_sql(rest)}"
    return f"CASE WHEN {x} >= 0 THEN {up} WHEN {x} < 0 THEN {down} END"


def _powers_sql(method: str) -> str:
    """power_sql of the columns x and e."""
    if method == "box_cox":
        return "CASE WHEN x > 0 THEN CASE WHEN e = 0 THEN ln(x) ELSE (pow(x, e) - 1) / e END END"
    up = "CASE WHEN e = 0 THEN log1p(x) ELSE (pow(x + 1, e) - 1) / e END"
    down = "CASE WHEN e = 2 THEN -log1p(-x) ELSE -(pow(1 - x, 2 - e) - 1) / (2 - e) END"
    return f"CASE WHEN x >= 0 THEN {up} WHEN x < 0 THEN {down} END"


def _slope_sql(x: str, method: str) -> str:
    """Logarithm of the transform's derivative, but for the factor (exponent - 1)."""
    return f"CASE WHEN {x} > 0 THEN ln({x}) END" if method == "box_cox" else f"signum({x}) * log1p(abs({x}))"


class PowerTransform(Estimator):
    """Brings columns near to a normal distribution: yeo_johnson, or box_cox for numbers above 0.

    The exponent of the greatest likelihood, -n/2 ln(population variance) + (exponent - 1)
    times the sum of the logarithmic slopes, is searched for all columns at once: each step is one
    aggregate over a grid of exponents, and narrows the range around the best of them.
    standardize scales the result to mean 0 and population deviation 1. Missing values stay
    missing; a column of one value or none keeps exponent 1.
    """

    def __init__(self, cols: Sequence[str], method: str = "yeo_johnson", standardize: bool = True):
        super().__init__()
        if method not in ("yeo_johnson", "box_cox"):
            raise ValueError(f"unknown power transform: {method}")
        self.cols, self.method, self.standardize = list(cols), method, standardize

    def likelihoods(self, df: DataFrame, grid: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
        """Log likelihood of each column's exponents, in one aggregate; None where it is undefined.

        Each number meets its column's exponents as rows: an aggregate of so many columns would be too large to compile.
        """
        numbers = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(double_sql(c)).alias("x")) for i, c in enumerate(grid)])
        rows = df.select(F.inline(numbers)).where("x is not null").withColumn("s", F.expr(_slope_sql("x", self.method)))
        points = df.sparkSession.createDataFrame([(i, j, float(e)) for i, es in enumerate(grid.values()) for j, e in enumerate(es)], "i int, j int, e double")
        made = rows.join(F.broadcast(points), "i").withColumn("v", F.expr(_powers_sql(self.method)))
        found = made.groupBy("i", "j", "e").agg(F.count("v").alias("n"), F.sum("s").alias("s"), F.var_pop("v").alias("v"))
        likelihood = F.expr("CASE WHEN v > 0 AND v < double('infinity') THEN -n / 2 * ln(v) + (e - 1) * s END")
        got = {(r["i"], r["j"]): r["l"] for r in found.select("i", "j", likelihood.alias("l")).collect()}  # one row an exponent
        return {c: [got.get((i, j)) for j in range(len(exponents))] for i, (c, exponents) in enumerate(grid.items())}

    def exponents(self, df: DataFrame) -> dict[str, float]:
        out = {}
        for some in chunks(list(dict.fromkeys(self.cols)), max(1, PER_JOB // CANDIDATES)):
            # every step reads these columns again, and a row takes CANDIDATES powers a column: kept, in tasks of bounded size
            rows = dealt(df.select(*map(col, some)), ROWS_PER_TASK).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                out |= self._searched(rows, some)
            finally:
                rows.unpersist()
        return {c: out.get(c, 1.0) for c in self.cols}

    def _searched(self, rows: DataFrame, cols: Sequence[str]) -> dict[str, float]:
        out, ranges = {}, {c: EXPONENTS for c in cols}
        for _ in range(STEPS):
            grid = {c: [lo + (hi - lo) * k / (CANDIDATES - 1) for k in range(CANDIDATES)] for c, (lo, hi) in ranges.items()}
            found = self.likelihoods(rows, grid)
            for c, values in found.items():
                best = max((k for k, v in enumerate(values) if v is not None), key=values.__getitem__, default=None)
                if best is not None:
                    out[c] = grid[c][best]
                    ranges[c] = (grid[c][max(0, best - 1)], grid[c][min(CANDIDATES - 1, best + 1)])
        return out

    def _fit(self, df: DataFrame) -> SQLTransformer:
        if not self.cols:
            return replacing({})
        made = {c: power_sql(double_sql(c), e, self.method) for c, e in self.exponents(df).items()}
        if self.standardize:
            row = df.agg(*[F.expr(f"{f}({e})").alias(f"{f}_{i}") for i, e in enumerate(made.values()) for f in ("avg", "stddev_pop")]).first()
            made = {c: f"(({e}) - {number_sql(row[f'avg_{i}'] or 0.0)}) / {number_sql(row[f'stddev_pop_{i}'] or 1.0)}" for i, (c, e) in enumerate(made.items())}
        return replacing(made)


# --- k bins ------------------------------------------------------------------


class KBins(Estimator):
    """Numbers as the index of their bin, 0 to k - 1: bins of equal width (uniform), of equal count (quantile) or around k means.

    A number on an edge belongs to the bin above it; what lies beyond the fitted range goes to the
    first or last bin. Quantile edges that coincide are one, so there may be fewer bins. Missing values
    stay missing. encode: "ordinal", or "one_hot" for a vector `<col>_bins` in the column's place (missing: zeros).
    """

    def __init__(self, cols: Sequence[str], k: int = 5, strategy: str = "quantile", encode: str = "ordinal"):
        super().__init__()
        if strategy not in ("uniform", "quantile", "kmeans") or encode not in ("ordinal", "one_hot") or k < 2:
            raise ValueError("unknown binning option")
        self.cols, self.k, self.strategy, self.encode = list(cols), k, strategy, encode

    def edges(self, df: DataFrame) -> dict[str, list[float]]:
        """The edges between bins, rising; without those at the ends."""
        if not self.cols:
            return {}
        inner = range(1, self.k)
        if self.strategy == "quantile":
            found = exact_quantiles(clean_nan(df), self.cols, [i / self.k for i in range(self.k + 1)])
            # an edge at the smallest or largest value would make a bin that holds nothing but it
            return {c: sorted({e for e in q[1:-1] if q[0] < e < q[-1]}) if q[0] is not None else [] for c, q in found.items()}
        row = df.agg(*[F.expr(f"{f}({double_sql(c)})").alias(f"{f}{i}") for i, c in enumerate(self.cols) for f in ("min", "max")]).first()
        ends = {c: (row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(self.cols)}
        even = {c: [lo + (hi - lo) * i / self.k for i in inner] if lo is not None and lo < hi else [] for c, (lo, hi) in ends.items()}
        return even if self.strategy == "uniform" else self.moved(df, ends, even)

    def moved(self, df: DataFrame, ends: dict, edges: dict[str, list[float]]) -> dict[str, list[float]]:
        """Edges half way between centres, moved until the centres stay: one aggregate a round over all columns."""
        centres = {c: [a + (b - a) / 2 for a, b in zip([ends[c][0], *e], [*e, ends[c][1]])] for c, e in edges.items() if e}
        for _ in range(KMEANS_ROUNDS):
            now = {c: [(a + b) / 2 for a, b in zip(m, m[1:])] for c, m in centres.items()}
            if not now:
                break
            aggs = [
                F.expr(f"avg(CASE WHEN {self.bin_sql(c, e)} = {b} THEN {double_sql(c)} END)").alias(f"m{i}_{b}")
                for i, (c, e) in enumerate(now.items()) for b in range(len(e) + 1)
            ]
            row = df.agg(*aggs).first()
            fresh = {c: [m if row[f"m{i}_{b}"] is None else row[f"m{i}_{b}"] for b, m in enumerate(centres[c])] for i, c in enumerate(now)}
            edges = {**edges, **now}
            if fresh == centres:
                break
            centres = fresh
        return edges

    @staticmethod
    def bin_sql(c: str, edges: Sequence[float]) -> str:
        x = double_sql(c)
        return f"CASE WHEN {x} IS NOT NULL THEN {' + '.join([f'int({x} >= {number_sql(e)})' for e in edges] or ['0'])} END"

    def _fit(self, df: DataFrame) -> SQLTransformer | PipelineModel:
        edges = self.edges(df)
        if self.encode == "ordinal":
            return replacing({c: self.bin_sql(c, e) for c, e in edges.items()})
        made = ", ".join(f"double(coalesce({self.bin_sql(c, e)}, {len(e) + 1})) AS {quoted(f'_bin{i}')}" for i, (c, e) in enumerate(edges.items()))
        if not made:
            return replacing({})
        binned = SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__")
        encoders = []
        for i, (c, e) in enumerate(edges.items()):
            # one slot a bin; the one behind them, dropped, stands for missing values
            sized = df.sparkSession.range(len(e) + 2).select(F.col("id").cast("double").alias(f"_bin{i}"))
            encoders.append(OneHotEncoder(inputCols=[f"_bin{i}"], outputCols=[f"_vec{i}"], dropLast=True).fit(sized))
        gone = ", ".join([quoted(c) for c in edges] + [f"_bin{i}" for i in range(len(edges))] + [f"_vec{i}" for i in range(len(edges))])
        named = ", ".join(f"_vec{i} AS {quoted(c + '_bins')}" for i, c in enumerate(edges))
        return PipelineModel([binned, *encoders, SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), {named} FROM __THIS__")])


# --- variance threshold ------------------------------------------------------


class VarianceThreshold(Estimator):
    """Drops columns whose population variance is not above the threshold; those without any number go too."""

    def __init__(self, cols: Sequence[str], threshold: float = 0.0):
        super().__init__()
        self.cols, self.threshold = list(cols), threshold

    def variances(self, df: DataFrame) -> dict[str, float | None]:
        out = {}
        for some in chunks(self.cols):
            row = df.agg(*[F.expr(f"var_pop({double_sql(c)})").alias(f"v{i}") for i, c in enumerate(some)]).first()
            out |= {c: row[f"v{i}"] for i, c in enumerate(some)}
        return out

    def kept(self, df: DataFrame) -> list[str]:
        return [c for c, v in self.variances(df).items() if v is not None and v > self.threshold]

    def _fit(self, df: DataFrame) -> SQLTransformer:
        gone = [c for c in self.cols if c not in set(self.kept(df))]
        return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(map(quoted, gone))}) FROM __THIS__") if gone else replacing({})


# --- ordinals ----------------------------------------------------------------


class OrdinalEncode(Estimator):
    """Text as its place, from 0, in an order that the caller gives (else sorted order of the values seen in it).

    unknown is the code of values outside the order (None: missing); missing values get `missing`.
    """

    def __init__(self, orders: Mapping[str, Sequence[str]], unknown: int | None = -1, missing: int | None = None):
        super().__init__()
        for c, values in orders.items():
            if len(set(values)) != len(values):
                raise ValueError(f"a value stands twice in the order of {c}")
        self.orders, self.unknown, self.missing = {c: list(v) for c, v in orders.items()}, unknown, missing

    def _fit(self, df: DataFrame) -> SQLTransformer:
        sql = lambda v: "NULL" if v is None else str(int(v))
        made = {}
        for c, values in self.orders.items():
            text = category_sql(df, c)
            place = f"array_position(array({', '.join(map(text_sql, values))}), {text})" if values else "0"
            made[c] = f"int(CASE WHEN {text} IS NULL THEN {sql(self.missing)} WHEN {place} = 0 THEN {sql(self.unknown)} ELSE {place} - 1 END)"
        return replacing(made)


def sorted_orders(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """The values of each column in sorted order, for OrdinalEncode; each column's values have to fit a statement."""
    return {c: [r[0] for r in df.select(F.expr(category_sql(df, c)).alias("v")).where(col("v").isNotNull()).distinct().orderBy("v").collect()] for c in cols}


__all__ = ["KBins", "OrdinalEncode", "PowerTransform", "VarianceThreshold", "power_sql", "sorted_orders"]

"""Table profile: every section of a column-by-column report as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import (
    as_key,
    categorical_columns,
    chunks,
    clean_nan,
    col,
    columns_of,
    empty,
    group_keys,
    numeric_columns,
    percent,
    require_columns,
    rows_of,
    type_class,
    union_all,
)
from .frequency import top_values, value_counts
from .quantiles import exact_quantiles

PROFILE_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def prob_name(p: float) -> str:
    return f"p{round(p * 100)}"


# --- schema, memory, duplicates, dates ---------------------------------------


@dataclass(frozen=True)
class Facts:
    """What one scan tells of a table: rows, rows with a missing value, and of each column missing values, bytes and range of time."""

    rows: int
    any_missing: int
    missing: dict[str, int]
    bytes: dict[str, int]
    times: dict[str, tuple[str | None, str | None]]


def table_facts(df: DataFrame) -> Facts:
    """Several sections of a report from one aggregate (one for each COLUMNS_PER_JOB columns)."""
    clean = clean_nan(df)
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    gone = lambda c: col(c).isNull() | F.isnan(col(c)) if c in floating else col(c).isNull()
    total = F.lit(0)
    for c in df.columns:
        total = total + gone(c).cast("int")
    dates = set(columns_of(clean, "datetime64"))
    rows = any_missing = 0
    missing, sizes, times = {}, {}, {}
    for part in chunks(df.columns):
        aggs = [F.count(F.lit(1)).alias("_rows"), F.count_if(total > 0).alias("_any")]
        for i, c in enumerate(part):
            aggs += [F.count_if(gone(c)).alias(f"m{i}"), _bytes_of(df, c).alias(f"b{i}")]
            if c in dates:
                v = _as_time(df, c)
                aggs += [iso_text(F.min(v)).alias(f"a{i}"), iso_text(F.max(v)).alias(f"z{i}")]
        row = df.agg(*aggs).first()
        rows, any_missing = row["_rows"], row["_any"]
        for i, c in enumerate(part):
            missing[c], sizes[c] = row[f"m{i}"], row[f"b{i}"]
            if c in dates:
                times[c] = (row[f"a{i}"], row[f"z{i}"])
    return Facts(rows, any_missing, missing, sizes, times)


_scanned: ContextVar[tuple[DataFrame, Facts] | None] = ContextVar("scanned", default=None)


def _known(df: DataFrame) -> Facts | None:
    held = _scanned.get()
    return held[1] if held is not None and held[0] is df else None


@contextmanager
def one_scan(df: DataFrame) -> Iterator[None]:
    """Inside, shape, memory, dates and missing values of this very frame are told from one scan of it.

    Where that scan fails, because some column cannot be computed, each of them scans for itself.
    """
    try:
        facts = table_facts(df)
    except Exception:  # noqa: BLE001 - the sections that read the failing column tell
        yield
        return
    token = _scanned.set((df, facts))
    try:
        yield
    finally:
        _scanned.reset(token)


def table_shape(df: DataFrame) -> DataFrame:
    """(rows, cols)"""
    if (facts := _known(df)) is not None:
        return df.sparkSession.createDataFrame([(facts.rows, len(df.columns))], "rows long, cols long")
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)).cast("long"))


def column_types(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null): type class and filled values of each column."""
    df = clean_nan(df)
    parts = []
    for part in chunks(df.columns):
        wide = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(part)])
        parts.append(rows_of(wide, [
            F.struct(F.lit(c).alias("column"), F.lit(type_class(df.schema[c].dataType)).alias("dtype"),
                     F.col(f"n{i}").alias("non_null"))
            for i, c in enumerate(part)
        ]))
    return union_all(parts)


def schema_summary(df: DataFrame) -> DataFrame:
    """(column, dtype, null_count, nunique, high_cardinality), all from one frequency table."""
    df = clean_nan(df)
    counted = value_counts(df, df.columns, compact=True).groupBy("column").agg(
        F.count("value").alias("nunique"), F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
    )
    listed = df.sparkSession.createDataFrame(
        [(f.name, type_class(f.dataType)) for f in df.schema.fields], "column string, dtype string"
    )
    zero = F.lit(0).cast("long")
    # both sides hold one row per column of the table
    return listed.join(F.broadcast(counted), "column", "left").select(
        "column", "dtype", F.coalesce("null_count", zero).alias("null_count"), F.coalesce("nunique", zero).alias("nunique"),
        (F.coalesce("nunique", zero) > F.greatest(F.lit(50), F.floor(F.lit(0.2) * F.coalesce("rows", zero)))).alias("high_cardinality"),
    )


def high_cardinality(df: DataFrame, limit: int = 50) -> DataFrame:
    """(column, nunique) with nunique > max(50, int(0.2 n)); first `limit` in column order."""
    position = {c: i for i, c in enumerate(df.columns)}
    places = F.create_map(*[x for c, i in position.items() for x in (F.lit(c), F.lit(i))])
    return (
        schema_summary(df)
        .where("high_cardinality")
        .orderBy(places[F.col("column")])
        .limit(limit)
        .select("column", "nunique")
    )


_FIXED_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DayTimeIntervalType: 8,
}


def _bytes_of(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    for kind, width in _FIXED_WIDTH.items():
        if isinstance(dtype, kind):
            return F.count(col(name)) * F.lit(width).cast("long")
    if isinstance(dtype, T.DecimalType):
        return F.count(col(name)) * F.lit(8 if dtype.precision <= 18 else 16).cast("long")
    value = col(name)
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        value = F.to_json(F.struct(value.alias(name)))
    return F.coalesce(F.sum(F.octet_length(value).cast("long")), F.lit(0).cast("long"))


def memory_summary(df: DataFrame) -> DataFrame:
    """(column, bytes): bytes of data per column, and their sum in the row '(total)'."""
    if (facts := _known(df)) is not None:
        return df.sparkSession.createDataFrame([*facts.bytes.items(), ("(total)", sum(facts.bytes.values()))], "column string, bytes long")
    parts = []
    for part in chunks(df.columns):
        wide = df.agg(*[_bytes_of(df, c).alias(f"b{i}") for i, c in enumerate(part)])
        parts.append(rows_of(wide, [
            F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("bytes")) for i, c in enumerate(part)
        ]))
    per_column = union_all(parts)
    # one row per column: rolling those few rows up adds the total without a second scan
    return per_column.rollup("column").agg(F.sum("bytes").alias("bytes")).select(
        F.coalesce("column", F.lit("(total)")).alias("column"), "bytes"
    )


def duplicate_summary(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows, duplicate_rows_pct): rows equal to an earlier one."""
    df = clean_nan(df)
    groups = df.select(*group_keys(df)).groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    out = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("_kinds"))
    repeats = F.col("rows") - F.col("_kinds")
    return out.select("rows", repeats.alias("duplicate_rows"), percent(repeats, F.col("rows")).alias("duplicate_rows_pct"))


def iso_text(value: Column) -> Column:
    """ISO text of a timestamp, with microseconds only where there are any."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def _as_time(df: DataFrame, name: str) -> Column:
    return col(name).cast("timestamp_ntz") if isinstance(df.schema[name].dataType, T.DateType) else col(name)


def datetime_overview(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """(column, min, max) of every date or time column as ISO text."""
    if (facts := _known(df)) is not None:
        return df.sparkSession.createDataFrame([(c, *ends) for c, ends in facts.times.items()][:max_columns], "column string, min string, max string")
    cols = columns_of(df, "datetime64")[:max_columns]
    if not cols:
        return empty(df.sparkSession, "column string, min string, max string")
    aggs = []
    for i, c in enumerate(cols):
        v = _as_time(df, c)
        aggs += [iso_text(F.min(v)).alias(f"a{i}"), iso_text(F.max(v)).alias(f"b{i}")]
    return rows_of(df.agg(*aggs), [
        F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"))
        for i, c in enumerate(cols)
    ])


# --- numbers -----------------------------------------------------------------


def numeric_profile(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    probs: Sequence[float] = PROFILE_PROBS,
    *,
    sample_std: bool = False,
    quantiles: dict[str, list[float | None]] | None = None,
) -> DataFrame:
    """(column, count, missing, missing_pct, mean, std, min, max, p..) per numeric column.

    `quantiles` passes values fitted before for the same probs.
    """
    df = clean_nan(df)
    cols = numeric_columns(df) if cols is None else list(cols)
    std = F.stddev_samp if sample_std else F.stddev_pop
    def moments(part: Sequence[str]) -> list[Column]:
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(part):
            v = col(c).cast("double")
            aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), std(v).alias(f"s{i}"),
                     F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        return aggs

    got: list[tuple[Sequence[str], Row]] = []
    if quantiles is None:  # one pass for the moments and the sketch of the quantiles
        fitted = exact_quantiles(df, cols, probs, beside=moments, found=got)
    else:
        fitted = quantiles
        got = [(part, df.agg(*moments(part)).first()) for part in chunks(cols)]
    out: dict[str, list] = {}
    for part, row in got:
        for i, c in enumerate(part):
            missing = row["_rows"] - row[f"n{i}"]
            out[c] = [row[f"n{i}"], missing, missing / row["_rows"] * 100.0 if row["_rows"] else 0.0] + [row[f"{k}{i}"] for k in ("m", "s", "lo", "hi")]
    schema = ("column string, count long, missing long, missing_pct double, mean double, std double, min double, max double"
              + "".join(f", {prob_name(p)} double" for p in probs))
    # one short row per column
    return df.sparkSession.createDataFrame([(c, *out[c], *fitted[c]) for c in cols], schema)


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, quartiles, maximum."""
    out = numeric_profile(df, cols, (0.25, 0.5, 0.75), sample_std=True)
    return out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def iqr_outliers(
    df: DataFrame, cols: Sequence[str] | None = None, *, fence: str = "tukey",
    quartiles: dict[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """(column, iqr, outliers_low, outliers_high, outliers_pct).

    fence="tukey": above q3 + 1.5 iqr. fence="reference": above q3 - 1.5 iqr.
    """
    if fence not in ("tukey", "reference"):
        raise ValueError(f"unknown fence: {fence}")
    df = clean_nan(df)
    cols = numeric_columns(df) if cols is None else list(cols)
    schema = "column string, iqr double, outliers_low long, outliers_high long, outliers_pct double"
    if not cols:
        return empty(df.sparkSession, schema)
    quartiles = exact_quantiles(df, cols, (0.25, 0.75)) if quartiles is None else quartiles
    sign = 1.5 if fence == "tukey" else -1.5
    parts = []
    for part in chunks(cols):
        aggs = []
        for i, c in enumerate(part):
            q1, q3 = quartiles[c]
            v = col(c).cast("double")
            low, high = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + sign * (q3 - q1))
            aggs += [F.count(v).alias(f"n{i}"),
                     F.count_if(v < F.lit(low).cast("double")).alias(f"l{i}"),
                     F.count_if(v > F.lit(high).cast("double")).alias(f"h{i}")]
        structs = []
        for i, c in enumerate(part):
            q1, q3 = quartiles[c]
            structs.append(F.struct(
                F.lit(c).alias("column"), F.lit(None if q1 is None else q3 - q1).cast("double").alias("iqr"),
                F.col(f"l{i}").alias("outliers_low"), F.col(f"h{i}").alias("outliers_high"),
                percent(F.col(f"l{i}") + F.col(f"h{i}"), F.col(f"n{i}")).alias("outliers_pct"),
            ))
        parts.append(rows_of(df.agg(*aggs), structs))
    return union_all(parts)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are filled; NULL if undefined.

    The built-in `corr` raises on a constant column under ANSI rules.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) for each column pair a before b; undefined pairs dropped."""
    cols = list(cols)
    if len(cols) < 2:
        return empty(df.sparkSession, "col_a string, col_b string, corr double")
    return _pair_sums(df, cols)


def _pair_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete correlation of columns.

    Each task adds up, per Arrow batch, five k x k matrices of sums over values
    centered by the column means; only those matrices are shuffled.
    """
    import numpy as np
    import pandas as pd

    means = df.agg(*[F.coalesce(F.avg(col(c).cast("double")), F.lit(0.0)) for c in cols]).first()
    center = np.array(list(means))
    k = len(cols)

    def block_sums(batches):
        sums = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - center
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m, m.T @ (x * x)])
            sums = part if sums is None else sums + part
        if sums is not None:
            i, j = np.triu_indices(k, 1)
            yield pd.DataFrame({"i": i, "j": j, "n": sums[0][i, j], "sx": sums[1][i, j], "sy": sums[2][i, j],
                                "xy": sums[3][i, j], "xx": sums[4][i, j], "yy": sums[5][i, j]})

    numbers = df.select(*[col(c).cast("double").alias(f"c{n}") for n, c in enumerate(cols)])
    sums = numbers.mapInPandas(
        block_sums, "i long, j long, n double, sx double, sy double, xy double, xx double, yy double"
    ).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xy", "xx", "yy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx = F.col("xx") - F.try_divide(sx * sx, n)
    vy = F.col("yy") - F.try_divide(sy * sy, n)
    cov = F.col("xy") - F.try_divide(sx * sy, n)
    # rounding leaves a tiny variance on constant columns: treat it as zero
    flat = (vx <= F.col("xx") * 1e-12) | (vy <= F.col("yy") * 1e-12)
    names = F.array(*map(F.lit, cols))
    return sums.select(
        F.get(names, F.col("i").cast("int")).alias("col_a"), F.get(names, F.col("j").cast("int")).alias("col_b"),
        F.when(~flat, F.try_divide(cov, F.sqrt(vx * vy))).alias("corr"),
    ).where(F.col("corr").isNotNull())


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, k: int = 20) -> DataFrame:
    """(col_a, col_b, abs_corr): strongest k pairs of numeric columns."""
    df = clean_nan(df)
    cols = numeric_columns(df) if cols is None else list(cols)
    return (
        correlation_matrix(df, cols)
        .select("col_a", "col_b", F.abs("corr").alias("abs_corr"))
        .orderBy(F.round("abs_corr", 12).desc(), "col_a", "col_b")
        .limit(k)
    )


# --- categories --------------------------------------------------------------


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None, k: int = 30) -> DataFrame:
    """(column, nunique, rank, value, n): distinct values and the k most frequent ones."""
    cols = categorical_columns(df) if cols is None else list(cols)
    if not cols:
        return empty(df.sparkSession, "column string, nunique long, rank int, value string, n long")
    df = clean_nan(df)
    counted = value_counts(df, cols, compact=True)
    best = top_values(df, cols, k)
    unique = counted.groupBy("column").agg(F.count("value").alias("nunique"), F.sum("n").alias("_rows")).where("_rows > 0")
    return best.join(F.broadcast(unique), "column").select(
        "column", "nunique", "rank", as_key(F.col("value")).alias("value"), "n"
    )


# --- missing values ----------------------------------------------------------


def _percent_of(part: int, whole: int) -> float:
    return part / whole * 100.0 if whole else 0.0


def missingness(df: DataFrame) -> DataFrame:
    """(column, rows, missing, missing_pct)"""
    if (facts := _known(df)) is not None:
        return df.sparkSession.createDataFrame(
            [(c, facts.rows, n, _percent_of(n, facts.rows)) for c, n in facts.missing.items()], "column string, rows long, missing long, missing_pct double"
        )
    df = clean_nan(df)
    parts = []
    for part in chunks(df.columns):
        wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                      *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(part)])
        parts.append(rows_of(wide, [
            F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"m{i}").alias("missing"),
                     percent(F.col(f"m{i}"), F.col("_rows")).alias("missing_pct"))
            for i, c in enumerate(part)
        ]))
    return union_all(parts)


def missing_flags(df: DataFrame) -> list[Column]:
    return [col(c).isNull().cast("int").alias(c) for c in df.columns]


def missing_per_row(df: DataFrame) -> Column:
    total = F.lit(0)
    for c in df.columns:
        total = total + col(c).isNull().cast("int")
    return total


def rows_with_missing(df: DataFrame) -> DataFrame:
    """(rows, rows_with_any_missing, rows_with_any_missing_pct)"""
    if (facts := _known(df)) is not None:
        row = (facts.rows, facts.any_missing, _percent_of(facts.any_missing, facts.rows))
        return df.sparkSession.createDataFrame([row], "rows long, rows_with_any_missing long, rows_with_any_missing_pct double")
    df = clean_nan(df)
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing_per_row(df) > 0).alias("rows_with_any_missing"))
    return out.withColumn("rows_with_any_missing_pct", percent(F.col("rows_with_any_missing"), F.col("rows")))


def row_missing_counts(df: DataFrame, order_by: Sequence[str], n: int = 200) -> DataFrame:
    """Missing values per row for the first n rows in the given order."""
    df = clean_nan(df)
    return (
        df.select(*[col(c) for c in order_by], missing_per_row(df).alias("missing"))
        .orderBy(*order_by, "missing").limit(n)
    )


def missing_matrix(df: DataFrame, order_by: Sequence[str], n: int = 200) -> DataFrame:
    """0/1 missingness of each column for the first n rows in the given order."""
    df = clean_nan(df)
    keys = [col(c).alias(f"_key{i}") for i, c in enumerate(order_by)]
    flagged = df.select(*keys, *missing_flags(df))
    return flagged.orderBy(*[f"_key{i}" for i in range(len(keys))]).limit(n).drop(
        *[f"_key{i}" for i in range(len(keys))]
    )


def nullity_correlation(df: DataFrame) -> DataFrame:
    """(col_a, col_b, corr) between the missing-value indicators of columns."""
    df = clean_nan(df)
    return correlation_matrix(df.select(*missing_flags(df)), df.columns)


# --- target ------------------------------------------------------------------


def distinct_more_than(df: DataFrame, column: str, threshold: int) -> bool:
    """Whether a column has more than `threshold` distinct values.

    A sketch decides clear cases; only close ones are counted exactly.
    """
    rough = df.agg(F.approx_count_distinct(col(column), 0.02)).first()[0]
    if rough > 2 * threshold + 100:
        return True
    if threshold > 1000 and rough < threshold / 2:
        return False
    return df.select(col(column)).where(col(column).isNotNull()).distinct().count() > threshold


def is_classification_target(df: DataFrame, target: str) -> bool:
    """Training rule: text, or at most max(20, int(0.05 n)) distinct values."""
    if type_class(df.schema[target].dataType) == "object":
        return True
    return not distinct_more_than(df, target, max(20, int(0.05 * df.count())))


def autodetect_target(df: DataFrame) -> tuple[str, bool]:
    """(column, is_classification): a column with a usual target name, else the last one."""
    usual = ("target", "label", "labels", "class", "y")
    named = [c for c in df.columns if c.lower() in usual]
    column = named[0] if named else df.columns[-1]
    return column, is_classification_target(clean_nan(df), column)


def target_preview(df: DataFrame, target: str | None) -> DataFrame:
    """Tidy (metric, key, value) preview of the target column; empty if absent.

    More than 15 distinct numbers: regression (count, mean, std, p5, p50, p95).
    Otherwise: n_classes, the top 50 class counts, and the imbalance ratio.
    """
    schema = "metric string, key string, value double"
    if not target or target not in df.columns:
        return empty(df.sparkSession, schema)
    df = clean_nan(df.select(col(target)))
    numeric = type_class(df.schema[target].dataType) in ("int", "float", "bool")
    if numeric and distinct_more_than(df, target, 15):
        number = df.select(col(target).cast("double").alias(target))
        got = numeric_profile(number, [target], (0.05, 0.5, 0.95))
        return rows_of(got, [
            F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(m).cast("double").alias("value"))
            for m in ("count", "mean", "std", "p5", "p50", "p95")
        ])
    return class_preview(df, target)


def class_preview(df: DataFrame, target: str, k: int = 50) -> DataFrame:
    """Tidy (metric, key, value): n_classes, class_count per class (top k), imbalance."""
    require_columns(df, target)
    counted = value_counts(df, [target]).select("value", "n")
    summary = counted.agg(F.count("value").alias("n_classes"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    ratio = F.try_divide(F.col("hi").cast("double"), F.col("lo").cast("double"))
    head = rows_of(summary, [
        F.struct(F.lit("n_classes").alias("metric"), F.lit(None).cast("string").alias("key"),
                 F.col("n_classes").cast("double").alias("value")),
        F.struct(F.lit("imbalance_ratio").alias("metric"), F.lit(None).cast("string").alias("key"), ratio.alias("value")),
    ])
    top = counted.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k)
    return head.unionByName(top.select(
        F.lit("class_count").alias("metric"), as_key(F.col("value")).alias("key"), F.col("n").cast("double").alias("value")
    ))

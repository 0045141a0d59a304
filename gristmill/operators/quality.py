"""Combining, checking and typing tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import chunks, clean_nan, col, numeric_columns, percent, require_columns, rows_of, spread, type_class, union_all

# What counts as a number, and the date formats with their shapes.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
PARSABLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER_SHARE = 0.9
DATE_SHARE = 0.8
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?$"
DATE_FORMATS = [
    ("M/d/yyyy", r"^([0-9]/[0-9]{1,2}|[0-9]{2}/[0-9])/[0-9]{4}$"),
    ("M/d/yyyy H:mm", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$"),
    ("M/d/yyyy H:mm:ss", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]{3,8} [0-9]{1,2}, [0-9]{4}$"),
    ("yyyy/MM/dd", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"),
    ("MM/dd/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("dd.MM.yyyy", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"),
    ("MMM d yyyy", r"^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$"),
    ("d MMM yyyy", r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$"),
    ("yyyyMMdd", r"^[0-9]{8}$"),
]


def select_types(df: DataFrame, *classes: str, exclude: bool = False) -> DataFrame:
    """Columns of the given type classes ('number' means int and float)."""
    wanted = {c for k in classes for c in (("int", "float") if k == "number" else (k,))}
    keep = [f.name for f in df.schema.fields if (type_class(f.dataType) in wanted) != exclude]
    return df.select(*[col(c) for c in keep])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    require_columns(df, *names)
    return df.drop(*names)


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in the subset."""
    if subset is not None:
        require_columns(df, *subset)
    return clean_nan(df).na.drop(subset=list(subset) if subset is not None else None)


def fill_text(df: DataFrame, cols: Sequence[str], value: str = "") -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c), F.lit(value)) for c in cols})


def as_text(df: DataFrame, cols: Sequence[str], null_text: str | None = None) -> DataFrame:
    """Cast to text; `null_text` gives missing values a word."""
    def text(c):
        t = col(c).cast("string")
        return t if null_text is None else F.coalesce(t, F.lit(null_text))

    return clean_nan(df).withColumns({c: text(c) for c in cols})


def concat_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical union; columns are matched by name, absent ones become NULL."""
    if not frames:
        raise ValueError("no tables to combine")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def add_columns(df: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Horizontal combination of columns derived from the same rows: no join."""
    return df.withColumns(derived)


def top_rows(df: DataFrame, by: str, k: int, ties: Sequence[str] = (), *, ascending: bool = False) -> DataFrame:
    """k rows with the largest (or smallest) value of a column."""
    order = col(by).asc() if ascending else col(by).desc()
    return df.orderBy(order, *map(col, ties)).limit(k)


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*map(col, order_by)).limit(n)


def last_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[col(c).desc() for c in order_by]).limit(n)


def table_preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """(part, row): the first and last n rows as JSON."""
    row = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    head = first_rows(df, order_by, n).select(F.lit("head").alias("part"), row.alias("row"))
    tail = last_rows(df, order_by, n).select(F.lit("tail").alias("part"), row.alias("row"))
    return head.unionByName(tail)


# --- types -------------------------------------------------------------------


def parse_date(value: Column) -> Column:
    """Timestamp of a text; a format is tried only where the text has its shape."""
    parsed = F.when(value.rlike(ISO_DATE), value.try_cast("timestamp"))
    for pattern, shape in DATE_FORMATS:
        parsed = parsed.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)))
    return parsed


def inferred_types(df: DataFrame, *, try_datetime: bool = True) -> dict[str, str]:
    """Column -> 'number' or 'datetime' for text columns that hold such values."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out: dict[str, str] = {}
    for part in chunks(cols):
        texts = spread(df.select(*[col(c) for c in part]))
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(part):
            aggs += [F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).rlike(NUMBER)).alias(f"m{i}"),
                     F.count(parse_date(col(c))).alias(f"d{i}")]
        row = texts.agg(*aggs).first()
        for i, c in enumerate(part):
            dated = try_datetime or "date" in c.lower() or "time" in c.lower()
            if row[f"n{i}"] and row[f"m{i}"] / row[f"n{i}"] > NUMBER_SHARE:
                out[c] = "number"
            elif dated and row["_rows"] and row[f"d{i}"] / row["_rows"] > DATE_SHARE:
                out[c] = "datetime"
    return out


def infer_and_coerce(df: DataFrame, *, try_datetime: bool = True) -> DataFrame:
    """Turn text columns into numbers or timestamps where most values allow it."""
    found = inferred_types(df, try_datetime=try_datetime)
    # what does not parse becomes NULL
    casts = {
        c: F.when(F.trim(col(c)).rlike(PARSABLE), F.trim(col(c)).try_cast("double")) if kind == "number" else parse_date(col(c))
        for c, kind in found.items()
    }
    return df.withColumns(casts) if casts else df


# --- rules -------------------------------------------------------------------


def range_check(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """(column, min, max, n_total, n_within); n_within is NULL for a column without numbers."""
    require_columns(df, column)
    numeric = column in numeric_columns(df)
    within = F.count_if(col(column).between(low, high)) if numeric else F.lit(None).cast("long")
    return clean_nan(df).agg(F.count(F.lit(1)).alias("n_total"), within.alias("n_within")).select(
        F.lit(column).alias("column"), F.lit(float(low)).alias("min"), F.lit(float(high)).alias("max"), "n_total", "n_within"
    )


@dataclass(frozen=True)
class Rule:
    """One check: kind is not_null, range, in_set, regex or unique."""

    column: str
    kind: str
    args: dict[str, Any] = field(default_factory=dict)

    def passes(self) -> Column:
        c = col(self.column)
        if self.kind == "not_null":
            return c.isNotNull()
        if self.kind == "range":
            return c.isNull() | c.between(self.args["low"], self.args["high"])
        if self.kind == "in_set":
            return c.isNull() | c.isin(list(self.args["values"]))
        if self.kind == "regex":
            return c.isNull() | c.cast("string").rlike(self.args["pattern"])
        raise ValueError(f"unknown rule: {self.kind}")


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(column, rule, n_total, n_passed, pct_passed); missing values fail only not_null.

    All row-wise rules share one scan; each unique rule is one group-by whose
    partial counts absorb repeated values.
    """
    df = clean_nan(df)
    frames = []
    simple = [r for r in rules if r.kind != "unique"]
    for part in chunks(simple):
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(r.passes()).alias(f"p{i}") for i, r in enumerate(part)])
        frames.append(rows_of(wide, [
            F.struct(F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule"), F.col("_rows").alias("n_total"),
                     F.col(f"p{i}").alias("n_passed"))
            for i, r in enumerate(part)
        ]))
    for r in rules:
        if r.kind == "unique":
            n = df.groupBy(col(r.column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            ok = F.when((F.col("n") == 1) | F.col("v").isNull(), F.col("n")).otherwise(0)
            frames.append(n.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.coalesce(F.sum(ok), F.lit(0)).alias("n_passed")
            ).select(F.lit(r.column).alias("column"), F.lit("unique").alias("rule"), "n_total", "n_passed"))
    return union_all(frames).withColumn("pct_passed", percent(F.col("n_passed"), F.col("n_total")))

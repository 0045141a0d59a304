"""Shared rules: type classes, missing values, plan sizes, small-result helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Inputs estimated below this size are dealt over the cores before costly per-row work;
# larger ones have splits enough. Operators have one plan for all sizes.
SMALL_BYTES = 64 * 1024 * 1024

# Sides of a join up to this estimate may be broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024

# Fitted models hold their vocabulary on the driver; beyond this many values they refuse.
MAX_VOCABULARY = 1 << 20

# Small inputs are dealt out in pieces of about this size.
SPREAD_BYTES = 1024 * 1024

# Wide tables are aggregated this many columns at a time.
COLUMNS_PER_JOB = 50


def plan_bytes(df: DataFrame) -> int | None:
    """Size estimate Spark itself uses for broadcast decisions; None if unknown."""
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return None
    return int(str(jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= (SMALL_BYTES if limit is None else limit)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint behind a size check; otherwise Spark picks a shuffle join."""
    return F.broadcast(df) if is_small(df, BROADCAST_BYTES if limit is None else limit) else df


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input over the cores before costly per-row work.

    A small file is often a single split and would keep one core busy. Inputs
    above the size limit have splits enough and are left as they are.
    """
    size = plan_bytes(df)
    if size is None or size > SMALL_BYTES:
        return df
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, 1 + size // SPREAD_BYTES)
    return df.repartition(tasks) if tasks > 1 else df


def dealt(df: DataFrame, rows_per_task: int) -> DataFrame:
    """The rows in tasks of about so many; up to that many rows stay as they are.

    A file's row group is one split however large, so an input may have far fewer splits than its size asks for.
    """
    tasks = -(-df.count() // rows_per_task)
    return df.repartition(tasks) if tasks > 1 else df


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "timedelta64"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "object"


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) in classes]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "int", "float")


def categorical_columns(df: DataFrame) -> list[str]:
    """Object columns first, then booleans: the order the table profile lists them."""
    return columns_of(df, "object") + columns_of(df, "bool")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col(quoted(name))


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing: turn it into NULL in every float and double column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c)
            for c in df.columns
        ]
    )


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0.0 of an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.try_divide(part.cast("double"), whole.cast("double")) * 100.0
    )


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def json_safe(value: Column) -> Column:
    """NaN and infinities become NULL."""
    unsafe = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~unsafe, value)


def as_key(value: Column) -> Column:
    """Label text with the missing class named 'NaN'."""
    return F.coalesce(value.cast("string"), F.lit("NaN"))


def fingerprint(value: Column) -> Column:
    """Short exact stand-in for a long string key.

    Strings below 64 bytes stand for themselves; longer ones become their 64
    hexadecimal SHA-256 digits, so the two kinds cannot meet.
    """
    return F.when(F.octet_length(value) < 64, value).otherwise(F.sha2(value, 256))


def group_keys(df: DataFrame) -> list[Column]:
    """Whole-row grouping keys in which long strings travel as fingerprints."""
    keys = []
    for field in df.schema.fields:
        c = col(field.name)
        if isinstance(field.dataType, T.StringType):
            c = fingerprint(c)
        elif isinstance(field.dataType, T.BinaryType):
            c = F.sha2(c, 256)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = fingerprint(F.to_json(F.struct(c.alias("v"))))
        keys.append(c.alias(field.name))
    return keys


def chunks(items: Sequence, size: int = COLUMNS_PER_JOB) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def rows_of(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn the single row of a wide aggregate into one row per struct."""
    return one_row.select(F.inline(F.array(*structs)))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def bounded_values(df: DataFrame, what: str, limit: int = MAX_VOCABULARY) -> list:
    """Rows of a table that has to fit a fitted model; an error if there are too many."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application).

    Needed where the workers cannot import it, that is unless it is installed
    on the nodes or was passed with --py-files.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="gristmill-code-"), "gristmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)  # Spark distributes the file to the executors
    _shipped.add(context.applicationId)


def work_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the cluster names.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="gristmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the work folder that no other run uses."""
    token = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{work_dir(spark).rstrip('/')}/{name}-{token}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once to the shared work folder and read it back.

    For results several later jobs read: the stages behind it are not repeated,
    and a lost executor costs nothing that is already written.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

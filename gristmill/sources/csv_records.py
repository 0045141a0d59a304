"""CSV whose quoted values hold line breaks, read split by split.

A split that starts in the middle of a file cannot know whether it starts inside quotes.
So a first scan tells for each split in which state it ends for either state it may
start in; put one after the other, these give every split its state. A second scan
joins lines to records; pieces of records at the borders of splits, at most two a split,
are put together by a grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import materialize, ship_package

#: What a row of the second scan is: a record, the first record of a file, the begin of one that the split
#: leaves open, the end of one that an earlier split began, or lines in the middle of such a one.
RECORD, HEADER, BEGIN, END, MIDDLE = range(5)

_STATES = "file string, block long, from_new boolean, from_inside boolean, spans boolean"
_PIECES = "file string, block long, kind int, text string"


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted value is open behind the line. Quotes open a value at its start only; doubled ones are part of it."""
    at = 0
    if not inside:
        if line.startswith('"'):
            at = 1
        elif (at := line.find(sep + '"')) >= 0:
            at += len(sep) + 1
        else:
            return False
    while True:  # in a quoted value from here
        end = line.find('"', at)
        while end >= 0 and line[end + 1 : end + 2] == '"':
            end = line.find('"', end + 2)
        if end < 0:
            return True
        at = line.find(sep + '"', end + 1)
        if at < 0:
            return False
        at += len(sep) + 1


def lines_of(spark: SparkSession, path: str | list[str], line_sep: str = "\n") -> DataFrame:
    """(value, file, block): lines in order within their split, the block being the split's start."""
    lines = spark.read.option("lineSep", line_sep).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    files, blocks, values = batch.column("file").to_pylist(), batch.column("block").to_numpy(), batch.column("value").to_pylist()
    border = [i for i in range(1, len(values)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
    for a, b in zip([0, *border], [*border, len(values)]):
        if a < b:
            yield files[a], int(blocks[a]), values[a:b]


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, from_new, from_inside, spans) of every split with a quote: the state it ends in, by the state it starts in."""
    ship_package(lines.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, new, inside, spans = None, False, True, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "from_new": [new], "from_inside": [inside], "spans": [spans]})

        for batch in batches:
            for file, block, values in _runs(batch):
                if (file, block) != key:
                    if key:
                        yield done()
                    key, new, inside, spans = (file, block), False, True, False
                for line in values:
                    same = new == inside
                    new = ends_inside(line, new, sep)
                    inside = new if same else ends_inside(line, inside, sep)
                    spans = spans or new
        if key:
            yield done()

    return lines.where(F.contains("value", F.lit('"'))).mapInArrow(task, _STATES)


def starting_inside(lines: DataFrame, states: DataFrame) -> np.ndarray:
    """Hashes of the splits that start inside quotes, sorted: eight bytes for each such split.

    A split that ends in one state whatever it starts in settles the state; others keep or turn it.
    """
    splits = lines.select("file", "block").distinct().join(states, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("from_new") & ~F.col("from_inside")).cast("int")).over(before), F.lit(0))
    settled = F.when(F.col("from_new") == F.col("from_inside"), F.struct("from_new", "turns"))
    told = splits.withColumn("turns", turns).withColumn("last", F.last(settled, ignorenulls=True).over(before))
    since = F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))
    inside = F.coalesce(F.col("last.from_new"), F.lit(False)) != (since % 2 == 1)
    keys = told.where(inside).select(F.xxhash64("file", "block").alias("k"))
    return np.sort(np.array([r["k"] for r in keys.collect()], np.int64))


def csv_records(lines: DataFrame, sep: str, line_sep: str = "\n", header: bool = True) -> tuple[DataFrame, str | None]:
    """(record) texts of the whole input, and the header record of the first file."""
    spark = lines.sparkSession
    states = materialize(split_states(lines, sep), "splits")
    inside = spark.sparkContext.broadcast(starting_inside(lines, states))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, held, began = None, False, [], False
        first = False  # the next record is a file's first

        def piece() -> tuple:
            """What a split leaves open at its end."""
            return (*key, BEGIN if began else MIDDLE, line_sep.join(held))

        for batch in batches:
            out: list[tuple] = []
            keys = batch.column("k").to_numpy()
            row = 0
            for file, block, values in _runs(batch):
                if (file, block) != key:
                    if held:
                        out.append(piece())
                    key, held, began, first = (file, block), [], False, header and block == 0
                    at = int(np.searchsorted(inside.value, keys[row]))
                    open_ = at < len(inside.value) and bool(inside.value[at] == keys[row])
                row += len(values)
                for line in values:
                    if not held and not open_ and not line.strip():
                        continue
                    if not held and not open_ and '"' not in line:
                        out.append((*key, HEADER if first else RECORD, line))
                        first = False
                        continue
                    if not held:
                        began = not open_
                    held.append(line)
                    if '"' in line:
                        open_ = ends_inside(line, open_, sep)
                    if not open_:
                        out.append((*key, END if not began else HEADER if first else RECORD, line_sep.join(held)))
                        held, first = [], False
            yield from _as_batches(out)
        if held:
            yield from _as_batches([piece()])

    def _as_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            file, block, kind, text = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.string())],
                names=["file", "block", "kind", "text"],
            )

    pieces = materialize(lines.select("*", F.xxhash64("file", "block").alias("k")).mapInArrow(task, _PIECES), "records")
    begins = F.when(F.col("kind") == BEGIN, F.col("block"))
    order = Window.partitionBy("file").orderBy("block", (F.col("kind") == BEGIN).cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = pieces.where(F.col("kind") >= BEGIN).withColumn("group", F.last(begins, ignorenulls=True).over(order))
    whole = parts.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = whole.select(F.array_join(F.col("parts.text"), line_sep).alias("record"))
    # the begin of a record and the end of another may share a split; a group holds one record, so blocks order it
    records = pieces.where(F.col("kind") == RECORD).select(F.col("text").alias("record")).unionByName(joined)
    top = pieces.where(F.col("kind") == HEADER).orderBy("file").select("text").head()
    return records, None if top is None else top["text"]


def spans_lines(lines: DataFrame, sep: str) -> bool:
    """Whether any quoted value holds a line break."""
    return split_states(lines, sep).where("spans").limit(1).count() > 0


def _read(texts: DataFrame, options: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """Spark's CSV reader over a column of record texts."""
    spark = texts.sparkSession
    reader = spark._jsparkSession.read()
    for name, value in options.items():
        reader = reader.option(name, value)
    if schema is not None:
        reader = reader.schema(spark._jsparkSession.parseDataType(schema.json()))
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader.csv(strings), spark)


def parse(records: DataFrame, header: str | None, sep: str, schema: T.StructType | None = None) -> DataFrame:
    """Records parsed by Spark's own reader; types are inferred unless a schema is given."""
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    texts = records.select(F.regexp_replace("record", "\r\\z", "").alias("record"))
    if schema is not None:
        return _read(texts, options, schema)
    top = _read(records.sparkSession.createDataFrame([((header or "").removesuffix("\r"),)], "record string"), options)
    names = [n if n is not None else f"_c{i}" for i, n in enumerate(top.first() or [])]
    # as many columns as the header has: short records are filled, and a column without any value is text
    if not names:
        return top
    found = _read(texts, options | {"inferSchema": "true"})
    types = [f.dataType for f in found.schema.fields]
    wanted = T.StructType([T.StructField(n, types[i] if i < len(types) else T.StringType()) for i, n in enumerate(names)])
    return _read(texts, options, wanted)

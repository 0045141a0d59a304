"""Files opened and folders listed where the tasks run, by their URI; every name is kept, hidden ones too.

Spark's file sources leave out names that start with `_` or `.`. Here tasks ask the file
system themselves, folder by folder, and read only the parts of a file that they need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import empty, materialize, ship_package

#: Schemes that tasks can open; the Hadoop name of the object store differs.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}
#: Entries a task lists before it hands folders that it has not entered to others.
LISTED = 10_000
#: Bytes that a ranged read fetches at once.
RANGE = 4_096

_ENTRIES = "path string, length long, folder boolean"
_URI = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)?$", re.S)

_systems: dict[str, object] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, the cluster's own where it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def default_scheme(spark: SparkSession) -> str:
    """What stands before a path without scheme, for instance `file:`."""
    return qualified(spark, "/").rstrip("/")


def scheme_of(uri: str) -> str:
    m = _URI.match(uri)
    return m[1].lower() if m else "file"


def located(uri: str) -> tuple[object, str, str]:
    """(file system, path in it, what stands before that path in a URI)."""
    from pyarrow import fs

    m = _URI.match(uri)
    scheme, authority, path = (m[1].lower(), m[2] or "", m[3] or "/") if m else ("file", "", uri)
    if scheme not in SCHEMES:
        raise ValueError(f"tasks cannot open {scheme}: files")
    if scheme == "file":
        return _systems.setdefault("file", fs.LocalFileSystem()), "/" + path.lstrip("/"), "file:"
    root = f"{SCHEMES[scheme]}://{authority}"
    if root not in _systems:
        _systems[root] = fs.FileSystem.from_uri(root + "/")[0]
    inner = authority + path if SCHEMES[scheme] in ("s3", "gs") else path
    return _systems[root], inner, f"{scheme}://" + ("" if SCHEMES[scheme] in ("s3", "gs") else authority)


def opened(uri: str):
    """A seekable file; nothing is read yet."""
    system, path, _ = located(uri)
    return system.open_input_file(path)


def _listed(uri: str) -> tuple[list[tuple[str, int]], list[str]]:
    """Files (path, length) directly in a folder, and its folders; a file is listed as itself."""
    from pyarrow import fs

    system, path, before = located(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(before + info.path, info.size)], []
    if info.type == fs.FileType.NotFound:
        return [], []
    inside = system.get_file_info(fs.FileSelector(path))
    return [(before + i.path, i.size) for i in inside if i.type == fs.FileType.File], [before + i.path for i in inside if i.type == fs.FileType.Directory]


def _walk(recursive: bool, limit: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders, seen = batch.column("path").to_pylist(), 0
            while folders and seen < limit:
                found, inner = _listed(folders.pop())
                seen += len(found) + 1
                folders += inner if recursive else []
                if found:
                    yield pa.RecordBatch.from_pydict({"path": [p for p, _ in found], "length": pa.array([n for _, n in found], pa.int64()), "folder": [False] * len(found)})
            if folders:
                yield pa.RecordBatch.from_pydict({"path": folders, "length": pa.array([0] * len(folders), pa.int64()), "folder": [True] * len(folders)})

    return task


def list_folders(folders: DataFrame, recursive: bool = True) -> DataFrame:
    """(path, length) of all files in or below the folders given as (path); missing ones have none.

    Tasks list a bounded number of entries each and hand on what they have not entered,
    so a deep tree takes a few rounds and a wide one many tasks.
    """
    spark = folders.sparkSession
    ship_package(spark)
    tasks = spark.sparkContext.defaultParallelism
    out, k = None, 0
    while True:
        entries = materialize(folders.select("path").repartition(tasks).mapInArrow(_walk(recursive, LISTED), _ENTRIES), "listing")
        files = entries.where("not folder").select("path", "length")
        out = files if out is None else out.unionByName(files)
        folders, k = entries.where("folder"), k + 1
        if not recursive or not folders.limit(1).count():
            return out


def list_tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length) of every file below a root, or of the root if it is a file; none if it is absent."""
    whole = qualified(spark, root)
    if scheme_of(whole) in SCHEMES:
        return list_folders(spark.createDataFrame([(whole,)], "path string"), recursive)
    return _by_driver(spark, whole, recursive)


def _by_driver(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """For file systems that only Spark's JVM knows: the driver lists, a name at a time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return empty(spark, "path string, length long")
    found, rows = system.listFiles(at, recursive), []
    while found.hasNext():
        entry = found.next()
        rows.append((entry.getPath().toString(), entry.getLen()))
    return spark.createDataFrame(rows, "path string, length long")


def read_contents(files: DataFrame) -> DataFrame:
    """The files given as (path, ..) with their `content`; one file is held at a time."""
    ship_package(files.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                with opened(path) as f:
                    data = f.read()
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*row.schema.names, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(task, fields + ", content binary")


def write_contents(files: DataFrame, folder: str) -> int:
    """Write (path, content) rows as files below a folder that all executors share; the number of files."""
    spark = files.sparkSession
    ship_package(spark)
    root = qualified(spark, folder).rstrip("/")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                system, path, _ = located(f"{root}/{name.lstrip('/')}")
                system.create_dir(path.rpartition("/")[0])
                with system.open_output_stream(path) as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(task, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Ranged:
    """A file that is sliced like bytes; only the ranges asked for are read, and `taken` counts them."""

    def __init__(self, file, size: int | None = None):
        self.file, self.size = file, file.size() if size is None else size
        self.taken, self._at, self._held = 0, 0, b""

    def __len__(self) -> int:
        return self.size

    def _fetch(self, start: int, stop: int) -> bytes:
        if not self._at <= start <= stop <= self._at + len(self._held):
            self.file.seek(start)
            self._at, self._held = start, self.file.read(min(max(stop - start, RANGE), self.size - start))
            self.taken += len(self._held)
        return self._held[start - self._at : stop - self._at]

    def __getitem__(self, key: int | slice):
        if isinstance(key, slice):
            start, stop, _ = key.indices(self.size)
            return self._fetch(start, stop) if start < stop else b""
        if not -self.size <= key < self.size:
            raise IndexError(key)
        return self._fetch(key % self.size, key % self.size + 1)[0]

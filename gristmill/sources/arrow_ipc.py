"""Feather (Arrow IPC) files as a Spark data source: format 'feather'."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

BATCHES_PER_TASK = 8


def _open(path: str):
    """(file system, path) for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path.rstrip("/")
    return sorted(
        prefix + f.path[len(at.rstrip("/")):] for f in found
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
    )


class Slice(InputPartition):
    """A run of record batches of one file."""

    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class FeatherReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Slice]:
        out = []
        for name in _files(self.path):
            system, at = _open(name)
            with system.open_input_file(at) as f:
                n = pa.ipc.open_file(f).num_record_batches
            out += [Slice(name, i, min(i + BATCHES_PER_TASK, n)) for i in range(0, n, BATCHES_PER_TASK)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, at = _open(partition.path)
        with system.open_input_file(at) as f:
            reader = pa.ipc.open_file(f)
            for i in range(partition.start, partition.stop):
                yield reader.get_batch(i)


class Written(WriterCommitMessage):
    def __init__(self, temporary: str | None, final: str | None):
        self.temporary, self.final = temporary, final


class FeatherWriter(DataSourceArrowWriter):
    """One file per task under a hidden name; the commit makes them visible."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        hidden, final = f"{at}/_{self.job}-{name}", f"{at}/part-{name}.feather"
        sink = writer = None
        for batch in iterator:
            if writer is None:
                sink = system.open_output_stream(hidden)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return Written(None, None)
        writer.close()
        sink.close()
        return Written(hidden, final)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = _open(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and f.base_name.endswith(".feather"):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.temporary:
                system.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None and m.temporary:
                system.delete_file(m.temporary)


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Feather files at {self.options['path']}")
        system, at = _open(files[0])
        with system.open_input_file(at) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> FeatherReader:
        return FeatherReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> FeatherWriter:
        return FeatherWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)

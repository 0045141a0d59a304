"""File collections: listing, modality, classes, archives, checksums."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import broadcast_if_small, col, ship_package
from . import access

# File extensions per modality, in the order they are tried.
EXTENSIONS = {
    "tabular": [".csv", ".parquet", ".feather", ".xlsx", ".xls", ".jsonl"],
    "image": [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff"],
    "audio": [".wav", ".mp3", ".flac", ".ogg", ".m4a"],
    "video": [".mp4", ".mov", ".avi", ".mkv", ".webm"],
    "text": [".txt", ".jsonl"],
}
IMAGE_EXTENSIONS = [*EXTENSIONS["image"], ".tif"]
CLASS_VIDEO_EXTENSIONS = [".mp4", ".avi", ".mov", ".mkv"]
#: Bytes of unpacked members that a task hands on together.
MEMBER_BYTES = 16_000_000
#: Members listed by a task before they go on.
MEMBER_ROWS = 1_000
DESCRIPTIONS = {
    "tabular": "Tabular data (CSV/Parquet/Excel/JSONL)",
    "text": "Unstructured text files",
    "image": "Images (JPG/PNG/WEBP/TIFF)",
    "audio": "Audio (WAV/MP3/FLAC/OGG/M4A)",
    "video": "Video (MP4/MOV/AVI/MKV/WEBM)",
    "unknown": "Unknown / mixed content",
}


def extension(path: Column) -> Column:
    """Lower-case suffix of the last path part, dot included; '' without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def modality_of(ext: Column) -> Column:
    kind = F.lit("unknown")
    for name in reversed(list(EXTENSIONS)):
        kind = F.when(ext.isin(EXTENSIONS[name]), name).otherwise(kind)
    return kind


def is_modality(path: Column, modality: str) -> Column:
    """Whether a path may be read as a modality (.jsonl is both tabular and text)."""
    return extension(path).isin(EXTENSIONS[modality])


def describe_modality(modality: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])[modality]


def _normal(exts: Sequence[str]) -> list[str]:
    return [("" if e.startswith(".") or not e else ".") + e.lower() for e in exts]


def list_files(spark: SparkSession, root: str, exts: Sequence[str] | None = None, *, recursive: bool = True) -> DataFrame:
    """(path, ext, length) of all files below a root, whatever their names; contents are not read. An absent root has none."""
    listed = access.list_tree(spark, root, recursive).select("path", extension(F.col("path")).alias("ext"), "length")
    return listed if exts is None else listed.where(F.col("ext").isin(_normal(exts)))


def with_content(spark: SparkSession, root: str, exts: Sequence[str] | None = None, *, recursive: bool = True) -> DataFrame:
    """(path, content) of the files below a root."""
    if access.scheme_of(access.qualified(spark, root)) in access.SCHEMES:
        return access.read_contents(list_files(spark, root, exts, recursive=recursive).select("path"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "content")
    return found if exts is None else found.where(extension(F.col("path")).isin(_normal(exts)))


# --- modality ----------------------------------------------------------------


def files_of_modality(listing: DataFrame, modality: str, limit: int | None = None) -> DataFrame:
    """Files whose extension belongs to the modality, by path."""
    hits = listing.where(modality_of(extension(F.col("path"))) == modality)
    return hits if limit is None else hits.orderBy("path").limit(limit)


def dataset_modality(listing: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups.., modality): tabular, image, audio, video, text, unknown - the first with any file."""
    ext = extension(F.col("path"))
    seen = listing.groupBy(*groups).agg(*[F.bool_or(ext.isin(v)).alias(k) for k, v in EXTENSIONS.items()])
    kind = F.lit("unknown")
    for name in reversed(list(EXTENSIONS)):
        kind = F.when(F.col(name), name).otherwise(kind)
    return seen.select(*groups, kind.alias("modality"))


def list_source(spark: SparkSession, path: str, modality: str | None = None, limit: int | None = None) -> DataFrame:
    """(path) of all files of a folder, of a ZIP's members (zip://<zip>#<member>) or of a single file, by path.

    With a modality, those whose extension belongs to it; the first `limit` by path, if given.
    """
    listing = list_files(spark, path).select("path")
    if path.lower().endswith(".zip"):
        listing = zip_members(listing).select("path")
    if modality is not None:
        return files_of_modality(listing, modality, limit)
    return listing if limit is None else listing.orderBy("path").limit(limit)


def detect_modality(spark: SparkSession, path: str, hint: str | None = None) -> str:
    """Modality of a file, folder or ZIP; a hint other than 'auto' wins; absent path: unknown."""
    return hint if hint and hint != "auto" else dataset_modality(list_source(spark, path)).first()[0]


# --- archives ----------------------------------------------------------------


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, zipfile.ZipFile | None, str | None]]:
    """Each archive, open, by its content or where its path leads: only its directory is read, at its end."""
    for batch in batches:
        contents = batch.column("content") if "content" in batch.schema.names else [None] * batch.num_rows
        for path, content in zip(batch.column("path").to_pylist(), contents):
            try:
                with io.BytesIO(content.as_py()) if content is not None else access.opened(path) as f, zipfile.ZipFile(f) as z:
                    yield path, z, None
            except (zipfile.BadZipFile, OSError, ValueError, TypeError, NotImplementedError) as e:
                yield path, None, f"{type(e).__name__}: {e}"[:500]


_LISTED = pa.schema([("zip", pa.string()), ("member", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("error", pa.string())])
_CONTENT = pa.schema([("zip", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for path, z, error in _archives(batches):
        rows += [(path, m.filename, f"zip://{path}#{m.filename}", m.file_size, None) for m in z.infolist() if not m.is_dir()] if z else [(path, None, None, None, error)]
        if len(rows) >= MEMBER_ROWS:
            yield _rows(_LISTED, rows)
            rows = []
    if rows:
        yield _rows(_LISTED, rows)


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, z, error in _archives(batches):
        if z is None:
            yield _rows(_CONTENT, [(path, None, None, error)])
            continue
        held, size = [], 0
        for m in z.infolist():
            if m.is_dir():
                continue
            try:
                held.append((path, m.filename, z.read(m), None))
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, OSError, ValueError, EOFError) as e:  # one member, not the archive
                held.append((path, m.filename, None, f"{type(e).__name__}: {e}"[:500]))
            size += m.file_size
            if size > MEMBER_BYTES:
                yield _rows(_CONTENT, held)
                held, size = [], 0
        if held:
            yield _rows(_CONTENT, held)


def _mapped(archives: DataFrame, task, schema: str) -> DataFrame:
    ship_package(archives.sparkSession)
    if "content" in archives.columns:
        return archives.select("path", "content").mapInArrow(task, schema)
    return archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism).mapInArrow(task, schema)


def zip_directory(archives: DataFrame) -> DataFrame:
    """(zip, member, path, length, error) of the files inside ZIPs given as (path), or as (path, content).

    By path, only the directory at an archive's end is read. An archive that is none has one row that says why.
    """
    return _mapped(archives, _list_members, "zip string, member string, path string, length long, error string")


def zip_members(archives: DataFrame) -> DataFrame:
    """(zip, member, path) of the files inside ZIPs given as (path), or as (path, content); broken archives have none."""
    return zip_directory(archives).where("error is null").select("zip", "member", "path")


def expand_zip(archives: DataFrame, errors: bool = False) -> DataFrame:
    """(zip, member, content): one row per file inside the ZIPs given as (path), or as (path, content).

    errors: also a row, and a column `error`, for each archive or member that cannot be read.
    """
    out = _mapped(archives, _read_members, "zip string, member string, content binary, error string")
    return out if errors else out.where("error is null").drop("error")


# --- checksums and classes ---------------------------------------------------


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def file_checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file."""
    return with_content(spark, root).select("path", sha256(F.col("content")).alias("sha256"))


def relative_path(path: Column, root: str) -> Column:
    """Path below the root; scheme prefixes of listed files are ignored."""
    clean = F.regexp_replace(path, "^[a-z0-9]+:/+(?=[^/])", "/")
    start = "/" + PurePosixPath(root.split("://", 1)[-1].removeprefix("file:")).as_posix().strip("/") + "/"
    return F.when(F.startswith(clean, F.lit(start)), F.substring(clean, F.lit(len(start) + 1), F.length(clean))).otherwise(path)


def class_of(path: Column, root: str) -> Column:
    """First folder below the root; for files directly in it, the root's own name."""
    parts = F.split(relative_path(path, root), "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(PurePosixPath(root.rstrip("/")).name))


def split_and_class(member: Column) -> Column:
    """struct(split, class) of a path like train/<class>/file or val/<class>/file."""
    parts = F.split(member, "/")
    known = F.lower(parts[0]).isin("train", "val")
    return F.struct(
        F.when(known, F.lower(parts[0])).alias("split"),
        F.when(known, F.when(F.size(parts) > 2, parts[1])).otherwise(F.when(F.size(parts) > 1, parts[0])).alias("class"),
    )


def labelled_files(spark: SparkSession, root: str, exts: Sequence[str]) -> DataFrame:
    """(path, class) of the files with the given extensions."""
    return list_files(spark, root, exts).select("path", class_of(F.col("path"), root).alias("class"))


def class_videos(listing: DataFrame, root: str) -> DataFrame:
    """(path, class) of the videos lying directly in a class folder below the root."""
    parts = F.split(relative_path(F.col("path"), root), "/")
    return listing.where(extension(F.col("path")).isin(CLASS_VIDEO_EXTENSIONS) & (F.size(parts) == 2)).select(
        "path", parts[0].alias("class")
    )


def resolve(path: Column, base_dir: str | None) -> Column:
    """Absolute form of a manifest path, relative ones taken from base_dir."""
    text = path.cast("string")
    return text if base_dir is None else F.when(text.rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:)?/"), text).otherwise(
        F.concat(F.lit(base_dir.rstrip("/") + "/"), F.regexp_replace(text, "^\\./", ""))
    )


def plain_path(path: Column) -> Column:
    """Listed paths without 'file:' so that they compare with manifest paths."""
    return F.regexp_replace(path, "^file:/+", "/")


def manifest_files(manifest: DataFrame, column: str, listing: DataFrame | None = None, base_dir: str | None = None) -> DataFrame:
    """Manifest rows with (full_path, found).

    Without a listing, the folders that the manifest's paths name are asked, wherever they
    lie: each once, in tasks. With one, only its files are found.
    """
    rows = manifest.withColumn("full_path", plain_path(resolve(col(column), base_dir)))
    if listing is None:
        scheme = access.default_scheme(manifest.sparkSession)
        folder = F.regexp_extract("full_path", "(?s)^(.*)/[^/]*$", 1)
        folder = F.when(folder == "", "/").otherwise(folder)
        named = rows.where("full_path is not null").select(F.when(folder.contains(":/"), folder).otherwise(F.concat(F.lit(scheme), folder)).alias("path")).distinct()
        listing = access.list_folders(named, recursive=False)
    present = listing.select(plain_path(F.col("path")).alias("full_path"), F.lit(True).alias("_there")).distinct()
    return (
        rows.join(broadcast_if_small(present), "full_path", "left")
        .withColumn("found", F.coalesce("_there", F.lit(False)))
        .drop("_there")
    )

"""Sources, sinks, file collections and media, on data derived from the tables."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..core import new_path
from ..operators import media as I
from ..sources import access as A
from ..sources import files as S
from ..sources import tables as T
from ..streaming import incremental as ST
from .registry import query, rounded, table, union_sql

CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _typed(df):
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


def _round_trip(spark, sf_dir, suffix):
    path = T.write_table(customers(spark, sf_dir), new_path(spark, "customers") + suffix)
    return _typed(T.read_table(spark, path))


for _kind in ("csv", "jsonl", "json", "parquet", "feather"):
    query(f"{_kind}_round_trip", CUSTOMERS)(lambda spark, sf_dir, k=_kind: _round_trip(spark, sf_dir, "." + k))


@query("csv_found_delimiter", CUSTOMERS)
def csv_found_delimiter(spark, sf_dir):
    path = new_path(spark, "semicolons") + ".csv"
    customers(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    return _typed(T.read_table(spark, path))


@query("whole_text_files", """
SELECT c_mktsegment AS segment, sum(length(c_name) + 1)::BIGINT AS chars FROM customer GROUP BY 1""")
def whole_text_files(spark, sf_dir):
    path = new_path(spark, "names")
    customers(spark, sf_dir).select("c_name", "c_mktsegment").write.partitionBy("c_mktsegment").text(path)
    texts = T.read_text(spark, path)
    return texts.groupBy(F.regexp_extract("path", "c_mktsegment=([^/]*)", 1).alias("segment")).agg(F.sum(F.length("text")).alias("chars"))


@query("csv_chunk_profile", union_sql([
    f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, 0.0::DOUBLE AS missing_pct, round(avg({c}), 6) AS mean,
  round(stddev_pop({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM customer""" for c in ("c_custkey", "c_acctbal")]))
def csv_chunk_profile(spark, sf_dir):
    """CSV files read a few at a time, totals kept across the batches."""
    path = T.write_table(customers(spark, sf_dir).repartition(4, "c_custkey"), new_path(spark, "chunks") + ".csv")
    stream = T.csv_stream(spark, path, customers(spark, sf_dir).schema, files_per_trigger=2)
    return rounded(ST.profile_stream(stream, ["c_custkey", "c_acctbal"]))


@query("csv_round_trip_texts", "SELECT doc_id, text FROM documents")
def csv_round_trip_texts(spark, sf_dir):
    """Texts with line breaks, quotes and delimiters written as CSV and read with the defaults."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = T.write_table(docs, new_path(spark, "texts") + ".csv")
    return T.read_table(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


# --- file names --------------------------------------------------------------

_NAMES = [".csv", ".JPG", ".wav", ".mp4", ".txt", ".bin", "", ".tar.png"]
PATHS = f"""(SELECT doc_id, lang, '/data/' || lang || '/' || doc_id || CASE doc_id % 8 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))} END AS path
  FROM documents)"""


def paths(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat(F.lit("/data/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path")
    )


_MODALITY = """CASE doc_id % 8 WHEN 0 THEN 'tabular' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'video' WHEN 4 THEN 'text'
  WHEN 7 THEN 'image' ELSE 'unknown' END"""
_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.DESCRIPTIONS.items())


@query("file_modality", f"""SELECT doc_id, lower(regexp_extract(path, '[^./](\\.[^./]+)$', 1)) AS ext, {_MODALITY} AS modality,
  CASE {_MODALITY} {_LABELS} END AS label, doc_id % 8 = 4 AS may_be_text FROM {PATHS}""")
def file_modality(spark, sf_dir):
    ext = S.extension(F.col("path"))
    return paths(spark, sf_dir).select("doc_id", ext.alias("ext"), S.modality_of(ext).alias("modality"),
                                       S.describe_modality(S.modality_of(ext)).alias("label"), S.is_modality(F.col("path"), "text").alias("may_be_text"))


@query("files_of_modality", f"SELECT doc_id, path FROM {PATHS} WHERE doc_id % 8 IN (1, 7)")
def files_of_modality(spark, sf_dir):
    return S.files_of_modality(paths(spark, sf_dir), "image").select("doc_id", "path")


@query("dataset_modality", """SELECT lang, CASE lang WHEN 'en' THEN 'tabular' ELSE 'image' END AS modality FROM (SELECT DISTINCT lang FROM documents)""")
def dataset_modality(spark, sf_dir):
    """Modality of each language's files, tables counted only among the English ones."""
    own = paths(spark, sf_dir).where((F.col("lang") == "en") | (F.col("doc_id") % 8 != 0))
    return S.dataset_modality(own, ["lang"])


@query("file_listing", "SELECT '.txt' AS ext, true AS found, sum(length(c_name) + 1)::BIGINT AS bytes FROM customer")
def file_listing(spark, sf_dir):
    path = new_path(spark, "listing")
    customers(spark, sf_dir).select("c_name", "c_mktsegment").write.partitionBy("c_mktsegment").text(path)
    listing = S.list_files(spark, path, ["TXT"])
    return listing.groupBy("ext").agg((F.count(F.lit(1)) > 0).alias("found"), F.sum("length").alias("bytes"))


def _groups(spark, sf_dir):
    """One file name per language and 200 document numbers; a third of them hidden by `_`, a third by `.`."""
    number = F.floor(F.col("doc_id") / 200).cast("long")
    docs = table(spark, sf_dir, "documents").groupBy("lang", number.alias("k")).agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))
    mark = F.element_at(F.array(F.lit("_"), F.lit("."), F.lit("")), (F.col("k") % 3 + 1).cast("int"))
    return docs.withColumn("name", F.concat(mark, F.lit("b"), F.col("k").cast("string")))


_GROUPS = """(SELECT lang, doc_id // 200 AS k, count(*) AS n, max(n_chars) AS most, ['_', '.', ''][doc_id // 200 % 3 + 1] || 'b' || (doc_id // 200) AS name
  FROM documents GROUP BY lang, doc_id // 200)"""


@query("file_names_kept", f"SELECT '_' || lang || '/' || name || '.TXT' AS path, '.txt' AS ext, n * 2 AS length FROM {_GROUPS}")
def file_names_kept(spark, sf_dir):
    """Files and folders whose names start with `_` or `.` are listed like others."""
    folder = new_path(spark, "names")
    files = _groups(spark, sf_dir).select(F.concat(F.lit("_"), "lang", F.lit("/"), "name", F.lit(".TXT")).alias("path"), F.repeat(F.lit("ab"), F.col("n").cast("int")).cast("binary").alias("content"))
    A.write_contents(files, folder)
    listing = S.list_files(spark, folder, ["txt"])
    return listing.select(S.relative_path(F.col("path"), folder).alias("path"), "ext", "length")


def _png(width, height):
    def word(c):
        return F.lpad(F.hex(c), 8, "0")

    return F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(width), word(height), F.lit("0802"), F.lit("000000"), F.repeat(F.lit("00"), 20_000)))


def _pictures(spark, sf_dir, folder):
    """A picture file of 20 KB per group, as wide as there are documents."""
    pictures = _groups(spark, sf_dir).select(F.concat("lang", F.lit("/"), "name", F.lit(".png")).alias("path"), _png(F.col("n"), F.col("most")).alias("content"))
    A.write_contents(pictures, folder)


@query("image_headers_of_files", f"SELECT lang || '/' || name || '.png' AS path, n::INTEGER AS width, most::INTEGER AS height, 'RGB' AS mode FROM {_GROUPS}")
def image_headers_of_files(spark, sf_dir):
    """Sizes by ranged reads: of each file only the header is fetched."""
    folder = new_path(spark, "pictures")
    _pictures(spark, sf_dir, folder)
    return I.image_headers(S.list_files(spark, folder, ["png"]).select("path")).withColumn("path", S.relative_path(F.col("path"), folder))


@query("manifest_of_folders", f"""SELECT lang AS class, count(*) AS rows_scanned, count(*) FILTER (k <> 1) AS found FROM {_GROUPS} GROUP BY 1""")
def manifest_of_folders(spark, sf_dir):
    """A manifest of absolute paths in folders apart from each other and from its base; some files are missing."""
    folder = new_path(spark, "apart")
    groups = _groups(spark, sf_dir)
    A.write_contents(groups.where("k <> 1").select(F.concat("lang", F.lit("/deep/"), "name", F.lit(".png")).alias("path"), F.lit("x").cast("binary").alias("content")), folder)
    root = A.qualified(spark, folder)
    manifest = groups.select(F.concat(F.lit(root + "/"), "lang", F.lit("/deep/"), "name", F.lit(".png")).alias("image"), F.col("lang").alias("class"))
    found = S.manifest_files(manifest, "image", base_dir="/absent")
    return found.groupBy("class").agg(F.count("*").alias("rows_scanned"), F.count_if("found").alias("found"))


@query("folder_classes", f"SELECT lang AS class, count(*) AS n FROM {PATHS} GROUP BY 1")
def folder_classes(spark, sf_dir):
    return paths(spark, sf_dir).groupBy(S.class_of(F.col("path"), "/data").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("video_inventory", f"SELECT path, lang AS class FROM {PATHS} WHERE doc_id % 8 = 3")
def video_inventory(spark, sf_dir):
    return S.class_videos(paths(spark, sf_dir), "/data")


@query("split_folders", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' END AS split, lang AS class FROM documents""")
def split_folders(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = F.when(F.col("doc_id") % 3 == 0, "train/").when(F.col("doc_id") % 3 == 1, "val/").otherwise("")
    member = F.concat(part, "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return docs.select("doc_id", S.split_and_class(member).alias("s")).select("doc_id", "s.split", "s.class")


@query("text_checksums", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.sha256(F.col("text")).alias("sha256"))


def archives(spark, sf_dir):
    """One ZIP per document: its text below the folder of its language."""

    @F.arrow_udf("binary")
    def pack(name: pa.Array, text: pa.Array) -> pa.Array:
        def one(n, t):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(n, t)
            return out.getvalue()

        return pa.array((one(n.as_py(), t.as_py()) for n, t in zip(name, text)), pa.binary())

    name = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/zips/"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), pack(name, F.col("text")).alias("content")
    )


@query("zip_members", "SELECT '/zips/' || doc_id || '.zip' AS zip, lang || '/' || doc_id || '.txt' AS member, 'zip:///zips/' || doc_id || '.zip#' || lang || '/' || doc_id || '.txt' AS path FROM documents")
def zip_members(spark, sf_dir):
    return S.zip_members(archives(spark, sf_dir))


@query("zip_contents", "SELECT lang || '/' || doc_id || '.txt' AS member, sha256(text) AS sha256 FROM documents")
def zip_contents(spark, sf_dir):
    return S.expand_zip(archives(spark, sf_dir)).select("member", S.sha256(F.col("content")).alias("sha256"))


@query("zip_directory", """SELECT '/zips/' || doc_id || '.zip' AS zip, CASE WHEN doc_id % 13 <> 0 THEN lang || '/' || doc_id || '.txt' END AS member,
  CASE WHEN doc_id % 13 <> 0 THEN strlen(text) END AS length, doc_id % 13 = 0 AS broken FROM documents""")
def zip_directory(spark, sf_dir):
    """Members by the directories of the archives; an archive that is none has a row that says so."""
    broken = F.regexp_extract("path", "([0-9]+)[.]zip$", 1).cast("long") % 13 == 0
    mixed = archives(spark, sf_dir).withColumn("content", F.when(broken, F.substring("content", 1, 20)).otherwise(F.col("content")))
    return S.zip_directory(mixed).select("zip", "member", "length", F.col("error").isNotNull().alias("broken"))


@query("source_listing", f"""SELECT 'folder' AS kind, lang || '/' || name || '.png' AS path FROM {_GROUPS} UNION ALL SELECT 'zip', lang || '.jpg' FROM (SELECT DISTINCT lang FROM documents)
UNION ALL SELECT 'file', 'en/' || name || '.png' FROM {_GROUPS} WHERE lang = 'en' AND k = 0""")
def source_listing(spark, sf_dir):
    """The pictures of a folder, of a ZIP and of a single file by the same call."""
    folder = new_path(spark, "sources")
    _pictures(spark, sf_dir, folder)
    langs = [r["lang"] for r in table(spark, sf_dir, "documents").select("lang").distinct().collect()]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for lang in langs:
            z.writestr(f"{lang}.jpg", lang)
            z.writestr(f"{lang}.txt", lang)
    A.write_contents(spark.createDataFrame([("all.zip", packed.getvalue())], "path string, content binary"), folder)
    own = lambda at, kind: S.list_source(spark, at, "image").select(F.lit(kind).alias("kind"), F.col("path"))
    found = own(folder, "folder").unionByName(own(f"{folder}/en/_b0.png", "file"))
    members = own(f"{folder}/all.zip", "zip").withColumn("path", F.substring_index("path", "#", -1))
    return found.withColumn("path", S.relative_path(F.col("path"), folder)).unionByName(members)


@query("manifest_counts", """
SELECT count(*) AS rows_scanned, count(l.doc_id) AS images_found, count(*) - count(l.doc_id) AS missing_paths
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def manifest_counts(spark, sf_dir):
    """A manifest of all documents against the files of the labelled ones."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    manifest = table(spark, sf_dir, "documents").select(name.alias("image"))
    listing = table(spark, sf_dir, "labels").select(F.concat(F.lit("file:/pictures/"), name).alias("path"))
    return I.manifest_counts(S.manifest_files(manifest, "image", listing, "/pictures"))


# --- images ------------------------------------------------------------------

IMAGES = """(SELECT doc_id, '/img/' || lang || '/' || doc_id || '.png' AS path, lang AS class, doc_id % 13 = 0 AS bad, n_chars % 640 + 1 AS w, doc_id % 480 + 1 AS h,
  CASE doc_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' ELSE 'RGBA' END AS m FROM documents)"""


def images(spark, sf_dir):
    """PNG headers whose size comes from the document; every 13th file holds the text instead."""
    def word(c):
        return F.lpad(F.hex(c), 8, "0")

    color = F.element_at(F.array(F.lit("00"), F.lit("02"), F.lit("06")), (F.col("doc_id") % 3 + 1).cast("int"))
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(F.col("n_chars") % 640 + 1), word(F.col("doc_id") % 480 + 1),
                              F.lit("08"), color, F.lit("00000000000000")))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/img/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.col("lang").alias("class"),
        F.when(F.col("doc_id") % 13 == 0, F.col("text").cast("binary")).otherwise(header).alias("content"),
    )


@query("image_headers", f"""SELECT path, class, CASE WHEN NOT bad THEN w END::INTEGER AS width, CASE WHEN NOT bad THEN h END::INTEGER AS height,
  CASE WHEN NOT bad THEN m END AS mode FROM {IMAGES}""")
def image_headers(spark, sf_dir):
    return I.image_headers(images(spark, sf_dir))


@query("image_integrity", f"""SELECT count(*) AS images, count(*) FILTER (NOT bad) AS readable, count(*) FILTER (bad) AS corrupt,
  round(count(*) FILTER (bad) * 100.0::DOUBLE / count(*), 6) AS corrupt_pct, count(*) FILTER (NOT bad AND (w < 32 OR h < 32)) AS very_small FROM {IMAGES}""")
def image_integrity(spark, sf_dir):
    return rounded(I.image_integrity(I.image_headers(images(spark, sf_dir))))


@query("image_sizes", union_sql([f"""SELECT '{n}' AS "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max
  FROM (SELECT ({e})::DOUBLE AS v FROM {IMAGES} WHERE NOT bad)""" for n, e in [("width", "w"), ("height", "h"), ("aspect", "w::DOUBLE / h")]]))
def image_sizes(spark, sf_dir):
    return rounded(I.image_sizes(I.image_headers(images(spark, sf_dir))))


@query("image_modes", f"SELECT m AS mode, count(*) AS n FROM {IMAGES} WHERE NOT bad GROUP BY 1")
def image_modes(spark, sf_dir):
    return I.image_modes(I.image_headers(images(spark, sf_dir)))


@query("image_classes", f"SELECT class, count(*) AS n FROM {IMAGES} GROUP BY 1 ORDER BY n DESC, class LIMIT 20")
def image_classes(spark, sf_dir):
    return I.class_counts(images(spark, sf_dir))


@query("image_small_classes", "SELECT n_name AS class, count(s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) < 10 ORDER BY 1 LIMIT 50")
def image_small_classes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("class"))
    return I.small_classes(table(spark, sf_dir, "supplier").join(nation, "s_nationkey"))


PIXELS = "(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor((x + 1) * 127)::INTEGER) AS p FROM embeddings)"


def pictures(spark, sf_dir):
    """8 pixels high gray pictures made of the embedding values."""
    v = table(spark, sf_dir, "embeddings")
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127)), 2, "0"))
    return v.select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.floor(F.size("embedding") / 8).cast("int").alias("width"),
                    F.lit(1).alias("channels"), F.unhex(F.array_join(byte, "")).alias("data"))


@query("image_flip_scaled", f"""
SELECT vec_id::VARCHAR AS path, 8::INTEGER AS height, (len(p) // 8)::INTEGER AS width, 1::INTEGER AS channels,
  list_transform(range(0, len(p)), lambda i: round(p[i - i % (len(p) // 8) + (len(p) // 8) - i % (len(p) // 8)] / 255.0::DOUBLE, 5)) AS pixels FROM {PIXELS}""")
def image_flip_scaled(spark, sf_dir):
    out = I.transform_images(pictures(spark, sf_dir), I.ImageSteps(flip=True, normalize=True))
    return out.withColumn("pixels", F.transform("pixels", lambda x: F.round(x.cast("double"), 5)))


@query("image_augmented")
def image_augmented(spark, sf_dir):
    return I.transform_images(pictures(spark, sf_dir), I.ImageSteps(size=(16, 16), rotate=15, brighten=True, noise=True))


# --- audio and video ---------------------------------------------------------


def clips(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.lit(8000).alias("sr"), F.col("embedding").alias("samples"))


@query("audio_peak_normalized", """
SELECT vec_id AS clip_id, list_transform(embedding::DOUBLE[], lambda x: round(x / list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y))), 5)) AS samples FROM embeddings""")
def audio_peak_normalized(spark, sf_dir):
    wide = clips(spark, sf_dir).select("clip_id", F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    return wide.select("clip_id", F.transform(I.peak_normalize(F.col("samples")), lambda x: F.round(x, 5)).alias("samples"))


@query("audio_prepared")
def audio_prepared(spark, sf_dir):
    return I.preprocess_audio(clips(spark, sf_dir))


@query("mel_spectrogram")
def mel_spectrogram(spark, sf_dir):
    return I.mel_spectrogram(clips(spark, sf_dir))


@query("mfcc")
def mfcc(spark, sf_dir):
    return I.mfcc(clips(spark, sf_dir))


@query("frame_sampling", """
SELECT user_id AS video_id, event_id AS frame_idx FROM events WHERE event_id % greatest(1, CASE WHEN user_id % 30 > 0 THEN user_id % 30 ELSE 1 END) = 0""")
def frame_sampling(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), (F.col("user_id") % 30).alias("fps"))
    return I.sample_frames(frames).select("video_id", "frame_idx")

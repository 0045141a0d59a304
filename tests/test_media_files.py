import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import pixels, signal
from gristmill.functions.imageheader import read_header
from gristmill.operators import media
from gristmill.plans import reports
from gristmill.sources import files, tables
from gristmill.streaming import incremental


def png(width, height, color=2, depth=8):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    channels = {0: 1, 2: 3, 6: 4}[color]
    raw = b"".join(b"\0" + bytes(range(width * channels % 256)) + b"\0" * (width * channels - width * channels % 256) for _ in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_headers():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08" + struct.pack(">HHB", 7, 9, 3) + b"\0" * 9
    bmp = b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 5, -6, 1, 24)
    gif = b"GIF89a" + struct.pack("<HH", 3, 4)
    tiff = b"II*\0" + struct.pack("<IH", 8, 4) + b"".join(
        struct.pack("<HHIHH", t, 3, 1, v, 0) for t, v in [(256, 11), (257, 12), (262, 2), (277, 3)])
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + (19).to_bytes(3, "little") + (29).to_bytes(3, "little")
    assert [read_header(b) for b in (png(4, 5), png(4, 5, 6), png(4, 5, 0), jpeg, bmp, gif, tiff, webp)] == [
        (4, 5, "RGB"), (4, 5, "RGBA"), (4, 5, "L"), (9, 7, "RGB"), (5, 6, "RGB"), (3, 4, "P"), (11, 12, "RGB"), (20, 30, "RGBA")]
    assert [read_header(b) for b in (b"", None, b"\x89PNG\r\n\x1a\n", b"plain", b"\xff\xd8\xff")] == [None] * 5


def test_recorded_statistics(spark):
    sizes = [(180, 180), (389, 124), (1024, 1024), (1849, 593), (2554, 3031)]
    got = {r["column"]: r for r in media.image_sizes(spark.createDataFrame(sizes, "width int, height int")).collect()}
    assert got["width"]["mean"] == 1199.2 and got["width"]["std"] == pytest.approx(892.5929419393814)
    assert got["width"]["p90"] == 2272 and got["width"]["p99"] == pytest.approx(2525.8)
    assert got["height"]["p90"] == pytest.approx(2228.2) and got["height"]["std"] == pytest.approx(1070.560712897685)
    assert got["aspect"]["mean"] == pytest.approx(1.8195533630050271) and got["aspect"]["p99"] == pytest.approx(3.136334657020073)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pics")
    for name, data in [("cat/a.png", png(40, 50)), ("cat/deep/b.PNG", png(10, 50, 6)), ("dog/c.png", png(64, 64)),
                       ("top.png", png(33, 33)), ("dog/bad.jpg", b"nothing"), ("dog/note.txt", b"hi")]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "list.csv").write_text("image,label\ncat/a.png,cat\ndog/c.png,dog\ngone.png,\n")
    return str(root)


def test_folder_report(spark, folder):
    rows = reports.image_dataset_report(spark, folder).collect()
    got = {(r["section"], r["column"], r["metric"]): r["value"] for r in rows}
    assert got[("classes", None, "n_images")] == 5 and got[("classes", None, "n_classes")] == 3
    assert got[("integrity", None, "corrupt")] == 1 and got[("integrity", None, "very_small")] == 1
    assert got[("sizes", "width", "max")] == 64
    counts = {r["text"]: r["value"] for r in rows if r["section"] == "class_counts_top20"}
    assert counts == {"cat": 2, "dog": 2, folder.rsplit("/", 1)[1]: 1}


def test_manifest_report(spark, folder):
    rows = reports.image_dataset_report(spark, folder + "/list.csv", image_col="image", label_col="label").collect()
    got = {(r["section"], r["metric"]): r["value"] for r in rows}
    assert got[("manifest", "rows_scanned")] == 3 and got[("manifest", "images_found")] == 2 and got[("integrity", "readable")] == 2
    assert {r["text"] for r in rows if r["section"] == "class_counts_top20"} == {"cat", "dog", "NaN"}
    with pytest.raises(ValueError):
        reports.image_dataset_report(spark, folder + "/top.png")


def test_image_source_transforms(spark, folder):
    images = media.source_images(spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "a.png").load(folder))
    r = media.transform_images(images, media.ImageSteps(size=(224, 224), gray=True, normalize=True), bgr=True).first()
    assert (r["height"], r["width"], r["channels"]) == (224, 224, 1) and 0 <= min(r["pixels"]) and max(r["pixels"]) <= 1


def test_pixel_helpers():
    img = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (pixels.resize(img, 4, 4) == img).all() and pixels.resize(img, 8, 2).shape == (8, 2, 3)
    assert (pixels.rotate(img, 0) == img).all()
    assert (pixels.add_noise(img, 7) == pixels.add_noise(img, 7)).all()
    assert pixels.grayscale(np.full((1, 1, 3), 100, np.uint8))[0, 0] == 100


def test_listing_and_modality(spark, folder):
    assert files.list_files(spark, folder, ["png"]).count() == 4
    assert files.list_files(spark, folder, ["PNG"], recursive=False).count() == 1
    assert files.detect_modality(spark, folder) == "tabular" and files.detect_modality(spark, folder, "audio") == "audio"
    assert files.detect_modality(spark, folder + "/cat") == "image" and files.detect_modality(spark, folder + "/absent") == "unknown"
    assert files.files_of_modality(files.list_files(spark, folder), "image", limit=2).count() == 2
    assert files.file_checksums(spark, folder + "/dog/note.txt").first()["sha256"].startswith("8f434346648f6b96")


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("train/cat/1.png", png(3, 3))
        z.writestr("val/dog/2.txt", "x")
        z.mkdir("empty")
    path = str(tmp_path / "d.zip")
    archive = files.with_content(spark, path)
    members = files.expand_zip(archive).select("member", files.split_and_class(F.col("member")).alias("s"), F.length("content").alias("n"))
    assert sorted((r["member"], r["s"]["split"], r["s"]["class"]) for r in members.collect()) == [
        ("train/cat/1.png", "train", "cat"), ("val/dog/2.txt", "val", "dog")]
    assert files.detect_modality(spark, path) == "image"
    listed = files.files_of_modality(files.zip_members(archive), "image").first()["path"]
    assert listed.startswith("zip://") and listed.endswith("d.zip#train/cat/1.png")


@pytest.mark.parametrize("sep", tables.DELIMITERS)
def test_delimiters(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(sep.join(r) for r in [("a", "b", "c"), ("1", "x y", "2.5"), ("2", "z, w" if sep != "," else "z", "3.5")]))
    assert tables.sniff_delimiter(spark, str(path)) == sep
    df = tables.read_table(spark, str(path))
    assert df.columns == ["a", "b", "c"] and df.count() == 2 and dict(df.dtypes)["c"] == "double"


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 3}]')
    both = tables.read_tables(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.json")])
    assert both.count() == 4 and set(both.columns) == {"a", "b"}
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    default = spark.createDataFrame([(7,)], "a int")
    assert tables.read_json(spark, str(tmp_path / "none.json"), default).first()[0] == 7
    assert tables.read_text(spark, str(tmp_path / "none.txt"), "word").first()["text"] == "word"
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.bin")
    with pytest.raises(ValueError):
        tables.write_table(default, "x.bin")


@pytest.mark.parametrize("kind", ["csv", "jsonl", "json", "parquet", "feather"])
def test_written_tables_read_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'say "hi", ok', None), (2, None, 2.5), (3, "é", -1.0)], "a long, s string, x double").repartition(5)
    path = tables.write_table(df, str(tmp_path / f"t.{kind}"))
    got = tables.read_table(spark, path).select(F.col("a").cast("long"), "s", F.col("x").cast("double"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    tables.write_table(df.limit(1), path)
    assert tables.read_table(spark, path).count() == 1


def test_text_report_rows(spark, tmp_path):
    df = spark.createDataFrame([("a b a", "x"), ("b", None)], "t string, y string")
    report = reports.text_report(df, "t", "y")
    assert not [r for r in report.collect() if r["section"].endswith("_error")]
    path = tables.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(path).count() == report.count()


def test_failing_section_is_kept_apart(spark, monkeypatch):
    from gristmill.operators import profile

    def broken(df):
        raise RuntimeError("no memory numbers")

    monkeypatch.setattr(profile, "memory_summary", broken)
    got = {r["section"]: r["text"] for r in reports.table_report(spark.range(3)).collect()}
    assert got["memory_summary_error"] == "no memory numbers" and "numeric_stats" in got


# --- audio and video ---------------------------------------------------------


def tone(rate=8000, seconds=1.0, hz=440.0, silence=0.5):
    t = np.arange(int(rate * seconds)) / rate
    quiet = np.zeros(int(rate * silence))
    return np.concatenate([quiet, 0.5 * np.sin(2 * np.pi * hz * t), quiet])


def test_wav_to_features(spark, tmp_path):
    x = tone()
    with wave.open(str(tmp_path / "t.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.repeat((x * 32767).astype("<i2"), 2).tobytes())
    clips = media.wav_samples(files.with_content(spark, str(tmp_path), ["wav"]))
    r = clips.first()
    assert r["sr"] == 8000 and np.allclose(r["samples"], x, atol=1e-4)
    out = media.preprocess_audio(clips, target_sr=16000).first()
    assert max(map(abs, out["samples"])) == pytest.approx(1.0) and abs(len(out["samples"]) - 16000) < signal.FRAME + signal.HOP
    mel = media.mel_spectrogram(clips).collect()
    assert len(mel) == 1 + len(x) // signal.HOP and len(mel[0]["values"]) == 64
    values = np.array([m["values"] for m in mel])
    assert values.max() == pytest.approx(0.0) and values.min() >= -80.0001
    loudest = signal.mel_to_hz(np.linspace(0, float(signal.mel_scale(4000)), 66))[1:-1][values.max(axis=0).argmax()]
    assert abs(loudest - 440) < 60
    assert len(media.mfcc(clips).first()["values"]) == 20


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 5 * np.arange(800) / 800)
    y = signal.resample(x, 800, 1600)
    assert len(y) == 1600 and np.allclose(y, np.sin(2 * np.pi * 5 * np.arange(1600) / 1600), atol=1e-6)


def test_silent_clip(spark):
    clips = spark.createDataFrame([("q", 16000, [0.0] * 4000)], "clip_id string, sr int, samples array<float>")
    assert media.preprocess_audio(clips).first()["samples"] == []
    assert media.preprocess_audio(clips, trim=False).first()["samples"] == [0.0] * 4000


def test_frames(spark):
    df = spark.range(60).selectExpr("id as frame_idx", "25 as fps")
    assert [r[0] for r in media.sample_frames(df).orderBy("frame_idx").select("frame_idx").collect()] == [0, 25, 50]
    assert media.sample_frames(df, target=10).count() == 30 and media.sample_frames(df.withColumn("fps", F.lit(0))).count() == 60


# --- streaming ---------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    from gristmill.operators.profile import numeric_profile

    df = spark.range(1000).selectExpr("id", "if(id % 9 = 0, null, sqrt(id)) as v")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_files(spark, str(tmp_path / "in"), df.schema, files_per_trigger=2)
    got = {r["column"]: r for r in incremental.profile_stream(stream, ["id", "v"]).collect()}
    for r in numeric_profile(df, ["id", "v"]).collect():
        for c in ("count", "missing", "mean", "std", "min", "max"):
            assert got[r["column"]][c] == pytest.approx(r[c])


def test_members_of_many_archives_go_on_together():
    import io
    import zipfile

    import pyarrow as pa

    def packed(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, "x")
        return out.getvalue()

    batch = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [packed("1"), b"none", packed("2")]})
    listed = list(files._list_members(iter([batch])))
    assert len(listed) == 1 and listed[0].column("member").to_pylist() == ["1", None, "2"]

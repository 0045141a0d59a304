"""CSV over several splits, listings, archives, ranged headers, manifests, report sections, baselines, pruned retrieval."""

import io
import os
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import drift, media, retrieve
from gristmill.plans import reports
from gristmill.sources import access, csv_records, files, tables

# --- CSV ---------------------------------------------------------------------


def open_behind(line, inside, sep):
    """The same rule, a character at a time."""
    start, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
            start = False
        else:
            if c == '"' and start:
                inside = True
            start = c == sep
        i += 1
    return inside


def test_state_behind_a_line():
    rng = random.Random(3)
    for _ in range(20_000):
        line = "".join(rng.choices('",a b', k=rng.randrange(0, 12)))
        for inside in (False, True):
            # behind a closing quote, marks up to the next separator are part of no quoted value
            assert csv_records.ends_inside(line, inside, ",") == open_behind(line, inside, ","), (line, inside)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def odd_rows(n, seed):
    rng = random.Random(seed)
    pieces = ["plain", 'a "quoted" word', "two\nlines", "\n\n", ",", '""', " lead", "5\" pipe", "long " * 60 + "\n" + "tail " * 60, "é\n日本", "x,y\n1,2\n"]
    return [(i, rng.choice(pieces) + rng.choice(pieces) + "z", rng.choice([None, "k", "q,\nr"]), rng.random()) for i in range(n)]


def as_csv(rows, breaks="\n"):
    quote = lambda v: "" if v is None else str(v) if not isinstance(v, str) else '"' + v.replace('"', '""') + '"'
    return breaks.join(["id,text,kind,x"] + [",".join(map(quote, r)) for r in rows]) + breaks


@pytest.mark.parametrize("breaks", ["\n", "\r\n"])
def test_quoted_line_breaks_over_splits(spark, tmp_path, small_splits, breaks):
    rows = odd_rows(300, 1), odd_rows(40, 2)
    for k, own in enumerate(rows):
        (tmp_path / f"{k}.csv").write_text(as_csv(own, breaks), newline="")
    (tmp_path / "empty.csv").write_text("id,text,kind,x" + breaks, newline="")
    lines = csv_records.lines_of(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 50 and csv_records.spans_lines(lines, ",")
    got = tables.read_csv(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "string", "string", "double"]
    assert got.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, got.collect())) == sorted(rows[0] + rows[1], key=lambda r: (r[0], r[1])) or sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[0] + rows[1]))
    whole = spark.read.csv(str(tmp_path), header=True, inferSchema=True, multiLine=True, escape='"')
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.collect()))
    typed = tables.read_csv(spark, str(tmp_path), schema=got.schema)
    assert sorted(map(str, typed.collect())) == sorted(map(str, got.collect()))


def test_csv_without_breaks_and_stray_quotes(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("n;s\n" + "".join(f'{i};5" pipe {i}\n' for i in range(200)))
    got = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["n", "s"] and got.count() == 200 and got.where("s like '5\" pipe%'").count() == 200
    (tmp_path / "b.csv").write_text('n,"a ""name""",s\n1,2,"x\ny"\n\n2,3,z\n4\n')
    got = tables.read_csv(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["n", 'a "name"', "s"] and sorted(map(tuple, got.collect())) == [(1, 2, "x\ny"), (2, 3, "z"), (4, None, None)]


# --- listings and archives ---------------------------------------------------


def test_every_name_is_listed(spark, tmp_path, monkeypatch):
    for name in ("_cls/a.png", "_c.png", ".d.png", "e.png", "x=1/.h/_i.PNG", "a b/c%20d#.txt", "é/ü.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    for listed in (access.LISTED, 1):
        monkeypatch.setattr(access, "LISTED", listed)
        found = {r["path"].removeprefix(f"file:{tmp_path}/"): (r["ext"], r["length"]) for r in files.list_files(spark, str(tmp_path)).collect()}
        assert found == {"_cls/a.png": (".png", 2), "_c.png": (".png", 2), ".d.png": (".png", 2), "e.png": (".png", 2), "x=1/.h/_i.PNG": (".png", 2), "a b/c%20d#.txt": (".txt", 2), "é/ü.png": (".png", 2)}
    assert files.list_files(spark, str(tmp_path), ["png"], recursive=False).count() == 3 and files.list_files(spark, str(tmp_path / "none")).count() == 0
    assert {bytes(r["content"]) for r in files.with_content(spark, str(tmp_path)).collect()} == {b"12"}
    one = str(tmp_path / "_c.png")
    assert [r["path"] for r in files.list_source(spark, one, "image").collect()] == [f"file:{one}"] and files.detect_modality(spark, one) == "image"
    assert files.list_source(spark, str(tmp_path), "image", limit=2).count() == 2 and files.list_source(spark, str(tmp_path), "audio").count() == 0


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        Counted.taken += len(out)
        return out


def test_archives_by_their_directory(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for i in range(20):
            z.writestr(f"train/c{i % 2}/{i}.png", os.urandom(100_000))
        z.writestr("dir/", "")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    data = (tmp_path / "big.zip").read_bytes()
    (tmp_path / "torn.zip").write_bytes(data[:150_000] + bytes(50_000) + data[200_000:])  # one member's bytes are lost
    paths = files.list_files(spark, str(tmp_path), ["zip"]).select("path")
    listed = files.zip_directory(paths).collect()
    assert sum(r["error"] is None for r in listed) == 40 and {r["zip"].rsplit("/", 1)[1] for r in listed if r["error"]} == {"broken.zip", "empty.zip"}
    assert all(r["length"] == 100_000 for r in listed if r["member"])
    got = files.expand_zip(paths, errors=True).collect()
    bad = [(r["zip"].rsplit("/", 1)[1], r["member"] is None) for r in got if r["error"]]
    assert len(got) == 42 and ("broken.zip", True) in bad and ("torn.zip", False) in bad and sum(len(r["content"] or b"") for r in got) >= 37 * 100_000
    assert files.expand_zip(paths).columns == ["zip", "member", "content"]
    Counted.taken = 0
    monkeypatch.setattr(access, "opened", lambda path: Counted(data))
    import pyarrow as pa

    rows = [b.num_rows for b in files._list_members([pa.RecordBatch.from_pydict({"path": ["x.zip"]})])]
    assert rows == [20] and Counted.taken < 10_000 < len(data)


# --- ranged headers ----------------------------------------------------------


def png(w, h, more=b""):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", more)


def jpeg(w, h, segments):
    out = b"\xff\xd8"
    for size in segments:
        out += b"\xff\xe1" + struct.pack(">H", size + 2) + bytes(size)
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + bytes(9) + bytes(500_000)


def tiff(w, h):
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (262, 3, 1, 1), (277, 3, 1, 1)]
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    return b"II*\x00" + struct.pack("<I", 8 + 300_000) + bytes(300_000) + directory


PICTURES = {"a.png": (png(640, 480, bytes(400_000)), (640, 480, "RGB")), "b.jpg": (jpeg(33, 44, [60_000] * 5), (33, 44, "RGB")), "c.tif": (tiff(70, 80), (70, 80, "L")), "_d.png": (png(5, 6), (5, 6, "RGB")), "e.png": (b"no picture" * 50_000, None), "f.png": (b"", None)}


@pytest.mark.parametrize("name", PICTURES)
def test_only_headers_are_read(name):
    data, want = PICTURES[name]
    ranged = access.Ranged(io.BytesIO(data), len(data))
    assert media.read_header(ranged) == want
    assert ranged.taken <= 8 * access.RANGE and (len(data) < 100_000 or ranged.taken < len(data) / 10)


def test_ranged_slices():
    data = os.urandom(20_000)
    ranged, rng = access.Ranged(io.BytesIO(data), len(data)), random.Random(1)
    for _ in range(500):
        a, b = rng.randrange(-10, 20_010), rng.randrange(-10, 20_010)
        assert ranged[a:b] == data[a:b] and len(ranged) == len(data)
    assert ranged[5] == data[5] and ranged[-1] == data[-1]
    with pytest.raises(IndexError):
        ranged[20_000]


def test_folder_and_manifest_reports(spark, tmp_path):
    for name, (data, _) in PICTURES.items():
        (tmp_path / "one" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / name).write_bytes(data)
    (tmp_path / "apart").mkdir()
    (tmp_path / "apart" / "g.png").write_bytes(png(9, 9))
    told = {(r["section"], r["column"], r["metric"]): r["value"] for r in reports.image_folder_report(spark, str(tmp_path / "one")).collect()}
    assert told["integrity", None, "images"] == 6 and told["integrity", None, "corrupt"] == 2 and told["sizes", "width", "max"] == 640
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "m.csv").write_text(f"image,label\n../one/a.png,x\n{tmp_path}/apart/g.png,y\n{tmp_path}/one/_d.png,y\n{tmp_path}/gone/h.png,y\n")
    report = reports.image_manifest_report(spark, str(tmp_path / "lists" / "m.csv"), "image", "label", str(tmp_path / "one")).collect()
    told = {(r["section"], r["metric"]): r["value"] for r in report}
    assert told["manifest", "rows_scanned"] == 4 and told["manifest", "images_found"] >= 2 and told["integrity", "readable"] >= 2


# --- reports -----------------------------------------------------------------


def test_section_that_fails_while_it_runs(spark):
    """A cast that fails under ANSI rules ends the sections that read it, and no other."""
    df = spark.createDataFrame([(1, "5", "a"), (2, "x", "b")], "id long, t string, g string").select("id", F.col("t").cast("int").alias("bad"), "g")
    got = reports.table_report(df, "g").collect()
    failed = {r["section"] for r in got if r["section"].endswith("_error")}
    assert {"missingness_summary_error", "numeric_stats_error"} <= failed
    assert {"shape", "target_preview", "datetime_overview"} & {r["section"] for r in got} >= {"shape", "target_preview"}


# --- baselines ---------------------------------------------------------------


def test_published_baseline_is_whole(spark, tmp_path):
    path = str(tmp_path / "base")
    rows = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"))
    first = drift.publish_baseline(drift.fit_baseline(rows, "v"), path)
    loaded = drift.load_baseline(spark, path)
    before = drift.drift_scores(drift.bin_counts(rows, loaded), loaded).first()["psi"]
    second = drift.publish_baseline(drift.fit_baseline(rows.select((F.col("v") * 5).alias("v")), "v", bins=3), path)
    now, then = drift.load_baseline(spark, path), drift.load_baseline(spark, path, first)
    assert first != second and now.version == second and len(now.edges) == 2 and then.edges == loaded.edges and len(then.edges) == 9
    # a reader that loaded before the refit still has edges and shares of one version
    assert drift.drift_scores(drift.bin_counts(rows, loaded), loaded).first()["psi"] == pytest.approx(before, abs=1e-12)
    assert now.shares.count() == 3 and then.shares.count() == loaded.shares.count() == 10
    labels = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    drift.publish_baseline(drift.fit_baseline(labels, "c"), path)
    assert drift.load_baseline(spark, path).edges is None and drift.load_baseline(spark, path).shares.count() == 3


def test_baseline_stays_when_its_source_changes(spark, tmp_path):
    source = str(tmp_path / "rows")
    spark.range(100).selectExpr("cast(id as double) v").write.parquet(source)
    base = drift.fit_baseline(spark.read.parquet(source), "v")
    want = sorted(map(tuple, base.shares.collect()))
    spark.range(7).selectExpr("cast(id as double) v").write.mode("overwrite").parquet(source)
    assert sorted(map(tuple, base.shares.collect())) == want


# --- retrieval ---------------------------------------------------------------


@pytest.mark.parametrize("block", [20_000, 30])
def test_pruned_retrieval_is_exact(spark, block):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 16)) * 4
    v = np.concatenate([c + rng.normal(size=(40, 16)) * 0.2 for c in centres])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5_000 + i, rows) for i, rows in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    seen = {}
    got = retrieve.top_k_similar(df, "id", "v", df, "id", "v", 4, vectors_per_block=block, queries_per_pass=300, seen=seen).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    sims = np.round(u @ u.T, retrieve.DIGITS)
    want = {(str(q), int(i), n) for q in range(len(v)) for n, i in enumerate(np.argsort(-sims[q], kind="stable")[:4], 1)}
    want |= {(q, i, n) for q in ("5006", "5007") for n, i in ((1, 5006), (2, 5007))}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want
    assert seen["met"] < 0.3 * seen["pairs"]  # most pairs of query and centre are skipped


def test_retrieval_without_usable_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "id long, v array<double>")
    assert retrieve.top_k_similar(df, "id", "v", df, "id", "v", 4).count() == 0

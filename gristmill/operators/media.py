"""Image, audio and video collections as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import as_key, col, percent, require_columns, ship_package
from ..functions import pixels, signal
from ..functions.imageheader import read_header
from ..sources import access
from .profile import numeric_profile

# What counts as a very small image and as a small class.
TINY = 32
SMALL_CLASS = 10
SIZE_PROBS = (0.5, 0.9, 0.99)


# --- image headers and statistics --------------------------------------------


def image_headers(files: DataFrame) -> DataFrame:
    """Add (width, height, mode) read from the image headers; NULL for unreadable files.

    Headers come from `content` if there is such a column, else by ranged reads from the
    file at `path`, of which only the header structures are fetched.
    """
    if "content" in files.columns:
        meta, rows = _header_udf(False)("content"), files
    else:
        require_columns(files, "path")
        ship_package(files.sparkSession)
        meta, rows = _header_udf(True)("path"), files.repartition(files.sparkSession.sparkContext.defaultParallelism)
    return rows.withColumn("_meta", meta).select(*[col(c) for c in files.columns if c != "content"], "_meta.width", "_meta.height", "_meta.mode")


def header_at(path: str) -> tuple[int, int, str] | None:
    """(width, height, mode) of the image file at a path, or None."""
    try:
        with access.opened(path) as f:
            return read_header(access.Ranged(f))
    except (OSError, ValueError):
        return None


def _header_udf(by_path: bool):
    read = header_at if by_path else read_header

    @F.pandas_udf("width int, height int, mode string")
    def parse(given: pd.Series) -> pd.DataFrame:
        rows = [read(b) or (None, None, None) for b in given]
        return pd.DataFrame({
            "width": pd.array([r[0] for r in rows], dtype="Int32"),
            "height": pd.array([r[1] for r in rows], dtype="Int32"),
            "mode": [r[2] for r in rows],
        })

    return parse


def image_integrity(headers: DataFrame) -> DataFrame:
    """(images, readable, corrupt, corrupt_pct, very_small): counts over image headers."""
    bad = F.count_if(F.col("width").isNull())
    out = headers.agg(
        F.count(F.lit(1)).alias("images"), F.count("width").alias("readable"), bad.alias("corrupt"),
        F.count_if((F.col("width") < TINY) | (F.col("height") < TINY)).alias("very_small"),
    )
    return out.select("images", "readable", "corrupt", percent(F.col("corrupt"), F.col("images")).alias("corrupt_pct"), "very_small")


def image_sizes(headers: DataFrame) -> DataFrame:
    """Statistics of width, height and aspect ratio (images of zero height left out)."""
    sizes = headers.where(F.col("width").isNotNull()).select(
        F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"),
        F.when(F.col("height") > 0, F.col("width").cast("double") / F.col("height")).alias("aspect"),
    )
    return numeric_profile(sizes, ["width", "height", "aspect"], SIZE_PROBS).select(
        "column", "count", "mean", "std", "min", "p50", "p90", "p99", "max"
    )


def image_modes(headers: DataFrame, k: int = 10) -> DataFrame:
    """(mode, n) of the most frequent color modes."""
    return (
        headers.where(F.col("mode").isNotNull()).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "mode").limit(k)
    )


def class_counts(files: DataFrame, label: str = "class", k: int = 20) -> DataFrame:
    """(class, n) of the k largest classes; the missing class is 'NaN'."""
    return (
        files.groupBy(as_key(col(label)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "class").limit(k)
    )


def small_classes(files: DataFrame, label: str = "class", below: int = SMALL_CLASS, k: int = 50) -> DataFrame:
    """(class, n) of classes with fewer than `below` files, the first k by name."""
    return (
        files.groupBy(as_key(col(label)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < below).orderBy("class").limit(k)
    )


def class_count(files: DataFrame, label: str = "class") -> DataFrame:
    """(n_images, n_classes)"""
    per = files.groupBy(as_key(col(label)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_images"), F.count(F.lit(1)).alias("n_classes"))


def sample_paths(files: DataFrame, k: int = 8) -> DataFrame:
    return files.select("path").orderBy("path").limit(k)


def manifest_counts(resolved: DataFrame) -> DataFrame:
    """(rows_scanned, images_found, missing_paths) of a manifest joined to its files."""
    return resolved.agg(
        F.count(F.lit(1)).alias("rows_scanned"), F.count_if("found").alias("images_found"),
        F.count_if(~F.col("found")).alias("missing_paths"),
    )


# --- image transforms --------------------------------------------------------


@dataclass(frozen=True)
class ImageSteps:
    """Transforms in the order of the fields."""

    size: tuple[int, int] | None = None  # (height, width), usually (224, 224)
    gray: bool = False
    flip: bool = False
    rotate: float | None = None  # degrees, usually 15
    brighten: bool = False
    noise: bool = False
    normalize: bool = False  # values in 0..1


def transform_images(images: DataFrame, steps: ImageSteps, *, bgr: bool = False) -> DataFrame:
    """(path, height, width, channels, pixels) of images given as
    (path, height, width, channels, data) with 8-bit interleaved data.

    Noise is seeded by the path. bgr: channel order of the built-in image source.
    """
    out = "path string, height int, width int, channels int, pixels array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, h, w, ch, data, seed in pdf.itertuples(index=False):
                img = np.frombuffer(data, np.uint8).reshape(h, w, ch)
                if bgr and ch >= 3:
                    img = np.concatenate([img[..., 2::-1], img[..., 3:]], axis=2)
                if steps.size is not None:
                    img = pixels.resize(img, *steps.size)
                if steps.gray and img.shape[2] >= 3:
                    img = pixels.grayscale(img)[..., None]
                if steps.flip:
                    img = img[:, ::-1]
                if steps.rotate is not None:
                    img = pixels.rotate(img, steps.rotate)
                if steps.brighten:
                    img = pixels.brighten(img)
                if steps.noise:
                    img = pixels.add_noise(img, seed)
                value = img.astype(np.float32) / np.float32(255.0) if steps.normalize else img.astype(np.float32)
                yield pd.DataFrame({"path": [path], "height": [img.shape[0]], "width": [img.shape[1]],
                                    "channels": [img.shape[2]], "pixels": [value.ravel()]})

    seeded = images.select("path", "height", "width", "channels", "data", F.crc32(F.col("path").cast("binary")).alias("seed"))
    return seeded.mapInPandas(run, out)


def source_images(images: DataFrame) -> DataFrame:
    """The struct of the built-in image source as (path, height, width, channels, data); bad files dropped."""
    i = F.col("image")
    return images.where(i["nChannels"] > 0).select(
        i["origin"].alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data")
    )


# --- audio -------------------------------------------------------------------


def wav_samples(files: DataFrame) -> DataFrame:
    """(clip_id, sr, samples): mono waveforms of WAV files given as (path, content)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rate, x = signal.read_wav(content)
                yield pd.DataFrame({"clip_id": [path], "sr": [rate], "samples": [x.astype(np.float32)]})

    return files.select("path", "content").mapInPandas(decode, "clip_id string, sr int, samples array<float>")


def peak_normalize(samples: Column) -> Column:
    """Scale a waveform so that its largest absolute sample is 1; silence stays."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(samples, lambda x: x / peak)).otherwise(samples)


def preprocess_audio(
    clips: DataFrame, *, target_sr: int = 16_000, trim: bool = True, top_db: float = 20.0, normalize: bool = True
) -> DataFrame:
    """Resample, trim silence, scale to a peak of 1; (clip_id, sr, samples) in and out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for clip, rate, samples in zip(pdf["clip_id"], pdf["sr"], pdf["samples"]):
                x = signal.resample(np.asarray(samples, dtype=float), int(rate), target_sr)
                if trim:
                    x = signal.trim_silence(x, top_db)
                yield pd.DataFrame({"clip_id": [clip], "sr": [target_sr], "samples": [x.astype(np.float32)]})

    kind = clips.schema["clip_id"].dataType.simpleString()
    out = clips.select("clip_id", "sr", "samples").mapInPandas(run, f"clip_id {kind}, sr int, samples array<float>")
    return out.withColumn("samples", peak_normalize(F.col("samples"))) if normalize else out


def _features(clips: DataFrame, compute) -> DataFrame:
    kind = clips.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for clip, rate, samples in zip(pdf["clip_id"], pdf["sr"], pdf["samples"]):
                m = compute(np.asarray(samples, dtype=float), int(rate))
                yield pd.DataFrame({"clip_id": clip, "frame": np.arange(m.shape[1]), "values": list(m.T.astype(np.float32))})

    return clips.select("clip_id", "sr", "samples").mapInPandas(run, f"clip_id {kind}, frame int, values array<float>")


def mel_spectrogram(clips: DataFrame, bands: int = 64, n_fft: int = signal.FRAME, hop: int = signal.HOP) -> DataFrame:
    """(clip_id, frame, values): mel bands in decibels below the clip's loudest value."""
    return _features(clips, lambda x, rate: signal.to_db(signal.mel_power(x, rate, bands, n_fft, hop)))


def mfcc(clips: DataFrame, count: int = 20, bands: int = 64, n_fft: int = signal.FRAME, hop: int = signal.HOP) -> DataFrame:
    """(clip_id, frame, values): cepstral coefficients of each frame."""
    return _features(clips, lambda x, rate: signal.mfcc(signal.mel_power(x, rate, bands, n_fft, hop), count))


# --- video -------------------------------------------------------------------


def sample_frames(frames: DataFrame, fps: str = "fps", index: str = "frame_idx", target: int | None = 1) -> DataFrame:
    """Frames with index divisible by max(1, fps // target); a missing or zero rate counts as 1."""
    rate = F.when(col(fps) > 0, col(fps).cast("int")).otherwise(F.lit(1))
    step = F.greatest(F.lit(1), F.floor(rate / F.lit(target or 1)).cast("int"))
    return frames.where(col(index) % step == 0)

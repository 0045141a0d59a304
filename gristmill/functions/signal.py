"""Numpy helpers for one waveform: resampling, silence, mel bands."""

from __future__ import annotations

import io
import wave

import numpy as np

FRAME, HOP = 2048, 512
FLOOR = 1e-10


def read_wav(content: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in -1..1) of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128.0) / 128.0
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited resampling in the frequency domain; ceil(n * target / rate) samples."""
    if rate == target or not len(x):
        return x
    n = int(np.ceil(len(x) * target / rate))
    spectrum = np.fft.rfft(x)
    bins = n // 2 + 1
    padded = np.zeros(bins, dtype=complex)
    keep = min(bins, len(spectrum))
    padded[:keep] = spectrum[:keep]
    return np.fft.irfft(padded, n) * (n / len(x))


def frames(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    padded = np.pad(x, frame // 2)
    count = 1 + (len(padded) - frame) // hop
    return np.lib.stride_tricks.sliding_window_view(padded, frame)[:: hop][:count]


def trim_silence(x: np.ndarray, top_db: float, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Cut leading and trailing frames more than top_db below the loudest one."""
    if not len(x):
        return x
    power = np.maximum((frames(x, frame, hop) ** 2).mean(axis=1), FLOOR)
    loud = np.flatnonzero(10.0 * np.log10(power / power.max()) > -top_db)
    if not len(loud) or not np.any(x):
        return x[:0]
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)]


def mel_scale(hz: np.ndarray) -> np.ndarray:
    """Linear below 1 kHz, logarithmic above."""
    hz = np.asarray(hz, dtype=float)
    return np.where(hz < 1000.0, hz * 3.0 / 200.0, 15.0 + np.log(np.maximum(hz, 1e-9) / 1000.0) * 27.0 / np.log(6.4))


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, dtype=float)
    return np.where(mel < 15.0, mel * 200.0 / 3.0, 1000.0 * np.exp((mel - 15.0) * np.log(6.4) / 27.0))


def mel_filters(rate: int, n_fft: int, bands: int) -> np.ndarray:
    """Triangular filters of equal area, bands x (n_fft/2 + 1)."""
    freqs = np.fft.rfftfreq(n_fft, 1.0 / rate)
    points = mel_to_hz(np.linspace(0.0, float(mel_scale(rate // 2)), bands + 2))
    up = (freqs[None, :] - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - freqs[None, :]) / np.diff(points)[1:, None]
    return np.maximum(0.0, np.minimum(up, down)) * (2.0 / (points[2:] - points[:-2]))[:, None]


def mel_power(x: np.ndarray, rate: int, bands: int = 64, n_fft: int = FRAME, hop: int = HOP) -> np.ndarray:
    window = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n_fft) / n_fft)
    spectrum = np.abs(np.fft.rfft(frames(x, n_fft, hop) * window, axis=1)) ** 2
    return mel_filters(rate, n_fft, bands) @ spectrum.T


def to_db(power: np.ndarray, reference: float | None = None, top_db: float = 80.0) -> np.ndarray:
    """Decibels against a reference (default: the loudest value), at most top_db below the top."""
    reference = float(power.max()) if reference is None else reference
    db = 10.0 * np.log10(np.maximum(power, FLOOR)) - 10.0 * np.log10(max(reference, FLOOR))
    return np.maximum(db, db.max() - top_db)


def mfcc(power: np.ndarray, count: int = 20) -> np.ndarray:
    """Orthonormal cosine transform of the mel decibels."""
    db = to_db(power, 1.0)
    n = db.shape[0]
    k = np.arange(count)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n)[None, :] + 1) / (2 * n)) * np.sqrt(2.0 / n)
    basis[0] /= np.sqrt(2.0)
    return basis @ db

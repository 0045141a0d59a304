"""Numpy helpers for one image array (height x width x channels, RGB)."""

from __future__ import annotations

import numpy as np


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centers aligned."""
    def axis(n_in: int, n_out: int):
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n_in - 1), at - low

    y0, y1, fy = axis(img.shape[0], height)
    x0, x1, fx = axis(img.shape[1], width)
    fy, fx = fy[:, None, None], fx[None, :, None]
    f = img.astype(float).reshape(img.shape[0], img.shape[1], -1)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    low = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    out = np.rint(top * (1 - fy) + low * fy).astype(img.dtype)
    return out.reshape((height, width) + img.shape[2:])


def grayscale(img: np.ndarray) -> np.ndarray:
    return np.rint(img[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(img.dtype)


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Rotate around the center by nearest pixels; uncovered pixels are 0."""
    h, w = img.shape[:2]
    a = np.deg2rad(degrees)
    cy, cx = h // 2, w // 2
    y, x = np.mgrid[:h, :w]
    sx = np.rint(np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx).astype(int)
    sy = np.rint(np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros_like(img)
    out[inside] = img[sy[inside], sx[inside]]
    return out


def brighten(img: np.ndarray, gain: float = 1.1, offset: float = 10.0) -> np.ndarray:
    return np.clip(np.rint(img.astype(float) * gain + offset), 0, 255).astype(np.uint8)


def add_noise(img: np.ndarray, seed: int, deviation: float = 5.0) -> np.ndarray:
    noise = np.random.default_rng(seed).normal(0.0, deviation, img.shape)
    return np.clip(img + noise, 0, 255).astype(img.dtype)

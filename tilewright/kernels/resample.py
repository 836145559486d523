"""Images and fields put together from tiles, and values at places between pixels."""

from __future__ import annotations

import numpy as np


def assemble(tiles: list[dict], bands: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(values, there, x0, y0): one array (h, w, bands) from tiles that lie anywhere beside each other."""
    x0, y0 = min(t["x0"] for t in tiles), min(t["y0"] for t in tiles)
    x1, y1 = max(t["x0"] + t["w"] for t in tiles), max(t["y0"] + t["h"] for t in tiles)
    out, there = np.zeros((y1 - y0, x1 - x0, bands)), np.zeros((y1 - y0, x1 - x0), bool)
    for t in tiles:
        own = np.frombuffer(t["data"], t["dtype"]).reshape(t["h"], t["w"], -1)
        at = (slice(t["y0"] - y0, t["y0"] - y0 + t["h"]), slice(t["x0"] - x0, t["x0"] - x0 + t["w"]))
        out[at], there[at] = own, True
    return out, there, x0, y0


def _weights(t: np.ndarray, order: int) -> list[tuple[int, np.ndarray]]:
    """(step, weight) of the pixels around a place ``t`` (0 to 1) beyond a pixel."""
    if order == 1:
        return [(0, 1 - t), (1, t)]
    out = []
    for k in range(-1, 3):
        d = np.abs(t - k)
        out.append((k, np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))))
    return out


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """(n, bands): values of an image (h, w, bands) at places, nearest (0), bilinear (1) or cubic convolution (3). Places are
    taken to the image's edge where they lie beyond it."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    if order == 0:
        return img[np.minimum(np.floor(y + 0.5).astype(int), h - 1), np.minimum(np.floor(x + 0.5).astype(int), w - 1)]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((len(x), img.shape[2]))
    for j, wy in _weights(y - y0, order):
        for i, wx in _weights(x - x0, order):
            out += (wx * wy)[:, None] * img[np.clip(y0 + j, 0, h - 1), np.clip(x0 + i, 0, w - 1)]
    return out


def through(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places under a matrix; a third part of 0 counts as the smallest step."""
    w = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    w = np.where(w == 0, np.finfo(float).eps, w)
    return (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / w, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / w


def cast(values: np.ndarray, dtype: str) -> np.ndarray:
    """Values as a type of pixels: whole numbers are rounded, and cut at the type's ends."""
    kind = np.dtype(dtype)
    if kind.kind in "ui":
        ends = np.iinfo(kind)
        return np.clip(np.floor(values + 0.5), ends.min, ends.max).astype(kind)
    return values.astype(kind)

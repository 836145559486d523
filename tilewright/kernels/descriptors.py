"""Nearest descriptors of two images, block by block."""

from __future__ import annotations

import numpy as np

METRICS = ("euclidean", "manhattan", "chebyshev", "hamming", "cosine")


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows that belong together."""
    gap = a - b
    if metric == "euclidean":
        return np.sqrt((gap * gap).sum(axis=-1))
    if metric == "manhattan":
        return np.abs(gap).sum(axis=-1)
    if metric == "chebyshev":
        return np.abs(gap).max(axis=-1)
    if metric == "hamming":
        return (gap != 0).mean(axis=-1)
    if metric == "cosine":
        return 1 - (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))
    raise ValueError(f"unknown metric {metric}")


def _rough(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, quickly; for the Euclidean one squares, exact but for rounding."""
    if metric == "euclidean":
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    if metric == "cosine":
        return 1 - (a @ b.T) / np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None])
    return exact(a[:, None], b[None], metric)


def two_nearest(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``a``: the nearest row of ``b`` (the first of equals), its distance, and that of the second nearest
    (infinite if there is none).

    Products tell the candidates: all within rounding of the two least. Their distances are then worked out exactly.
    """
    best, first, second = np.zeros(len(a), np.int64), np.full(len(a), np.inf), np.full(len(a), np.inf)
    if not len(b):
        return best - 1, first, second
    step = max(1, min(block, (1 << 22) // max(len(b) * (1 if metric in ("euclidean", "cosine") else a.shape[1]), 1)))
    scale = float((a * a).sum(axis=1).max(initial=0) + (b * b).sum(axis=1).max(initial=0)) if metric == "euclidean" else 1.0
    for lo in range(0, len(a), step):
        d = _rough(a[lo : lo + step], b, metric)
        two = np.partition(d, 1, axis=1)[:, 1] if len(b) > 1 else d[:, 0]
        i, j = np.nonzero(d <= (two + 1e-9 * scale)[:, None])
        x = exact(a[lo + i], b[j], metric)
        order = np.lexsort((j, x, i))
        i, j, x = i[order], j[order], x[order]
        start = np.flatnonzero(np.diff(i, prepend=-1))
        best[lo + i[start]], first[lo + i[start]] = j[start], x[start]
        more = start[np.diff(start, append=len(i)) > 1] + 1
        second[lo + i[more]] = x[more]
    return best, first, second


def match(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", cross_check: bool = True, max_distance: float | None = None, max_ratio: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of rows of ``a`` and their nearest ones of ``b``.

    cross_check keeps those that are each other's nearest; max_distance is exclusive; max_ratio keeps those nearer than
    that part of the second nearest one's distance, or without a second.
    """
    j, d, second = two_nearest(a, b, metric)
    keep = np.isfinite(d)
    if cross_check and len(b):
        back, _, _ = two_nearest(b, a, metric)
        keep &= back[np.maximum(j, 0)] == np.arange(len(a))
    if max_distance is not None:
        keep &= d < max_distance
    if max_ratio is not None:
        keep &= ~np.isfinite(second) | (d < max_ratio * second)
    i = np.flatnonzero(keep)
    return i, j[i], d[i]

"""Kernels over dense images: sampling, smoothing, corners, optical flow, field inversion, morphology."""

from __future__ import annotations

import numpy as np


def sample_bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Values between pixels; ``fill`` outside."""
    h, w = img.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    out = np.zeros(np.broadcast(x, y).shape)
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    for dx, dy, k in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)):
        out += k * img[np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)]
    return np.where(inside, out, fill)


def sample_bicubic(img: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Cubic convolution (a = -0.5) over the 4 x 4 pixels around."""
    h, w = img.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)

    def weight(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))

    out = np.zeros(np.broadcast(x, y).shape)
    for j in range(-1, 3):
        for i in range(-1, 3):
            out += weight(x - x0 - i) * weight(y - y0 - j) * img[np.clip(y0 + j, 0, h - 1), np.clip(x0 + i, 0, w - 1)]
    return np.where((x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1), out, fill)


def warp(img: np.ndarray, m: np.ndarray, out_shape: tuple[int, int], field: np.ndarray | None = None, order: int = 1, fill: float = 0.0) -> np.ndarray:
    """An image under a matrix from destination to source, then a field of displacements of the result."""
    yy, xx = np.mgrid[: out_shape[0], : out_shape[1]].astype(float)
    if field is not None:
        xx, yy = xx + field[0], yy + field[1]
    w = m[2, 0] * xx + m[2, 1] * yy + m[2, 2]
    w = np.where(w == 0, np.finfo(float).eps, w)
    x, y = (m[0, 0] * xx + m[0, 1] * yy + m[0, 2]) / w, (m[1, 0] * xx + m[1, 1] * yy + m[1, 2]) / w
    if order == 0:
        x, y = np.floor(x + 0.5), np.floor(y + 0.5)
    return (sample_bicubic if order == 3 else sample_bilinear)(img, x, y, fill)


def gaussian(img: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothing along both axes, with the border's values beyond it."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-6)) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(img, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        img = sum(k[i] * np.take(padded, np.arange(i, i + img.shape[axis]), axis=axis) for i in range(2 * r + 1))
    return img


def harris(img: np.ndarray, n: int = 500, sigma: float = 1.5, k: float = 0.05, apart: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(points xy, responses) of the strongest corners that are the largest within ``apart`` pixels."""
    gy, gx = np.gradient(img.astype(float))
    a, b, c = gaussian(gx * gx, sigma), gaussian(gy * gy, sigma), gaussian(gx * gy, sigma)
    r = a * b - c * c - k * (a + b) ** 2
    padded = np.pad(r, apart, constant_values=-np.inf)
    largest = np.max([padded[j : j + r.shape[0], i : i + r.shape[1]] for j in range(2 * apart + 1) for i in range(2 * apart + 1)], axis=0)
    y, x = np.nonzero((r >= largest) & (r > 0))
    order = np.lexsort((x, y, -r[y, x]))[:n]
    return np.stack([x[order], y[order]], axis=1).astype(float), r[y, x][order]


#: The sixteen pixels of a circle of radius 3, in turn.
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def fast_corners(img: np.ndarray, n: int = 500, threshold: float = 10.0, arc: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(points xy, responses) of pixels with ``arc`` neighbours in a row on a circle that are all brighter, or all darker, by more than
    ``threshold``, strongest first, each the largest among the eight around it."""
    img = img.astype(float)
    if min(img.shape) < 7:
        return np.zeros((0, 2)), np.zeros(0)
    core = img[3:-3, 3:-3]
    ring = np.stack([img[3 + j : img.shape[0] - 3 + j, 3 + i : img.shape[1] - 3 + i] - core for j, i in CIRCLE])
    response = np.zeros(img.shape)
    for beyond in (ring > threshold, ring < -threshold):
        row = np.zeros(core.shape, bool)
        for k in range(16):
            row |= np.take(beyond, np.arange(k, k + arc) % 16, axis=0).all(axis=0)
        strength = np.where(beyond, np.abs(ring) - threshold, 0).sum(axis=0)
        response[3:-3, 3:-3] = np.maximum(response[3:-3, 3:-3], np.where(row, strength, 0))
    y, x = np.nonzero((response > 0) & (response >= window_extreme(response, [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1)], False)))
    order = np.lexsort((x, y, -response[y, x]))[:n]
    return np.stack([x[order], y[order]], axis=1).astype(float), response[y, x][order]


def binary_descriptors(img: np.ndarray, xy: np.ndarray, bits: int = 256, radius: float = 12.0) -> np.ndarray:
    """Descriptors of 0 and 1: which of two places around a point is darker, for ``bits`` pairs of places that are the same for all points."""
    rng = np.random.default_rng(0)
    pairs = np.clip(rng.normal(0, radius / 2.5, (bits, 4)), -radius, radius)
    smooth = gaussian(img.astype(float), 2.0)
    mean = float(smooth.mean())
    a = sample_bilinear(smooth, xy[:, :1] + pairs[None, :, 0], xy[:, 1:] + pairs[None, :, 1], mean)
    b = sample_bilinear(smooth, xy[:, :1] + pairs[None, :, 2], xy[:, 1:] + pairs[None, :, 3], mean)
    return (a < b).astype(float)


def patch_descriptors(img: np.ndarray, xy: np.ndarray, side: int = 8, step: float = 2.0) -> np.ndarray:
    """Unit-length patches around points, without their mean."""
    o = (np.arange(side) - (side - 1) / 2) * step
    gx, gy = np.meshgrid(o, o)
    smooth = gaussian(img.astype(float), step / 2)
    d = sample_bilinear(smooth, xy[:, :1] + gx.ravel()[None], xy[:, 1:] + gy.ravel()[None], float(smooth.mean()))
    d = d - d.mean(axis=1, keepdims=True)
    return d / np.maximum(np.sqrt((d * d).sum(axis=1, keepdims=True)), 1e-9)


def optical_flow(fixed: np.ndarray, moving: np.ndarray, levels: int = 3, rounds: int = 60, smooth: float = 8.0) -> np.ndarray:
    """A backward field (2, h, w) with moving(x + dx, y + dy) near fixed(x, y): coarse to fine, each level by
    Horn and Schunck's iteration on the warped image."""
    if min(fixed.shape) < 16 or levels <= 1:
        flow = np.zeros((2, *fixed.shape))
    else:
        half = lambda a: gaussian(a, 1.0)[::2, ::2]
        low = optical_flow(half(fixed), half(moving), levels - 1, rounds, smooth)
        yy, xx = np.mgrid[: fixed.shape[0], : fixed.shape[1]] / 2
        yy, xx = np.minimum(yy, low.shape[1] - 1), np.minimum(xx, low.shape[2] - 1)
        flow = np.stack([2 * sample_bilinear(low[i], xx, yy) for i in (0, 1)])
    base = flow.copy()
    warped = warp(moving, np.eye(3), fixed.shape, base, fill=float(moving.mean()))
    gy, gx = np.gradient((warped + fixed) / 2)
    gt = warped - fixed
    for _ in range(rounds):
        mean = np.stack([(np.pad(f, 1, mode="edge")[:-2, 1:-1] + np.pad(f, 1, mode="edge")[2:, 1:-1] + np.pad(f, 1, mode="edge")[1:-1, :-2] + np.pad(f, 1, mode="edge")[1:-1, 2:]) / 4 for f in flow])
        step = (gx * (mean[0] - base[0]) + gy * (mean[1] - base[1]) + gt) / (smooth + gx * gx + gy * gy)
        flow = np.stack([mean[0] - gx * step, mean[1] - gy * step])
    return flow


def invert_field(field: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The field that undoes a backward field, by fixed-point iteration."""
    yy, xx = np.mgrid[: field.shape[1], : field.shape[2]].astype(float)
    v = -field
    for _ in range(rounds):
        x, y = np.clip(xx + v[0], 0, field.shape[2] - 1), np.clip(yy + v[1], 0, field.shape[1] - 1)
        v = -np.stack([sample_bilinear(field[i], x, y) for i in (0, 1)])
    return v


def fill_smoothly(img: np.ndarray, gap: np.ndarray, there: np.ndarray, rounds: int = 200) -> np.ndarray:
    """An image of which the pixels of ``gap`` are the mean of their neighbours, as far as ``rounds`` of averaging take it."""
    known = there & ~gap
    if not gap.any() or not known.any():
        return img
    out, have = np.where(known, img, 0.0), known.astype(float)
    for _ in range(rounds):
        p, q = np.pad(out * have, 1), np.pad(have, 1)
        total = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
        n = q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:]
        out = np.where(gap & (n > 0), total / np.maximum(n, 1), out)
        have = np.where(gap, n > 0, have).astype(float)
    return out


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """A mask grown by a disk."""
    padded = np.pad(mask, radius)
    out = np.zeros_like(mask)
    for j in range(-radius, radius + 1):
        for i in range(-radius, radius + 1):
            if i * i + j * j <= radius * radius:
                out |= padded[radius + j : radius + j + mask.shape[0], radius + i : radius + i + mask.shape[1]]
    return out


def total_variation(img: np.ndarray, weight: float = 0.1, rounds: int = 100) -> np.ndarray:
    """A denoised image: dual projection steps on the total variation."""
    p = np.zeros((2, *img.shape))

    def divergence(q: np.ndarray) -> np.ndarray:
        d = q.sum(axis=0)
        d[1:] -= q[0, :-1]
        d[:, 1:] -= q[1, :, :-1]
        return d

    for _ in range(rounds):
        u = divergence(p) - img / weight
        g = np.zeros_like(p)
        g[0, :-1], g[1, :, :-1] = u[1:] - u[:-1], u[:, 1:] - u[:, :-1]
        p = (p + 0.25 * g) / (1 + 0.25 * np.sqrt((g * g).sum(axis=0)))
        p[0, -1], p[1, :, -1] = 0, 0
    return img - weight * divergence(p)


def edge_strength(img: np.ndarray) -> np.ndarray:
    """Length of the gradient, with the neighbours of a row weighted 3, 10, 3."""
    p = np.pad(img.astype(float), 1, mode="edge")
    mix = lambda a, b, c: (3 * a + 10 * b + 3 * c) / 16
    dx = mix(p[:-2, 2:] - p[:-2, :-2], p[1:-1, 2:] - p[1:-1, :-2], p[2:, 2:] - p[2:, :-2])
    dy = mix(p[2:, :-2] - p[:-2, :-2], p[2:, 1:-1] - p[:-2, 1:-1], p[2:, 2:] - p[:-2, 2:])
    return np.sqrt(dx * dx + dy * dy) / 2


def disk(radius: int) -> list[tuple[int, int]]:
    """(dy, dx) of the pixels of a disk."""
    r = range(-radius, radius + 1)
    return [(j, i) for j in r for i in r if i * i + j * j <= radius * radius]


def window_extreme(img: np.ndarray, offsets: list[tuple[int, int]], least: bool) -> np.ndarray:
    """The least or greatest value among a pixel's neighbours at ``offsets``; what lies outside doesn't count."""
    ry, rx = max(abs(j) for j, _ in offsets), max(abs(i) for _, i in offsets)
    p = np.pad(img.astype(float), ((ry, ry), (rx, rx)), constant_values=np.inf if least else -np.inf)
    out = None
    for j, i in offsets:
        part = p[ry + j : ry + j + img.shape[0], rx + i : rx + i + img.shape[1]]
        out = part.copy() if out is None else (np.minimum if least else np.maximum)(out, part)
    return out


def opening(img: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return window_extreme(window_extreme(img, offsets, True), offsets, False)


def local_entropy(img: np.ndarray, radius: int, there: np.ndarray | None = None) -> np.ndarray:
    """Entropy, in bits, of the values of 0 to 255 in a disk around each pixel, of the pixels that are there."""
    img = np.clip(img, 0, 255).astype(np.int64)
    there = np.ones(img.shape, bool) if there is None else there
    offsets = disk(radius)
    p = np.pad(np.where(there, img, -1), radius, constant_values=-1)
    stack = np.sort(np.stack([p[radius + j : radius + j + img.shape[0], radius + i : radius + i + img.shape[1]] for j, i in offsets]), axis=0)
    n = (stack >= 0).sum(axis=0)
    # Runs of equal values of the sorted neighbours: a run of k adds k ln k.
    out, run = np.zeros(img.shape), np.zeros(img.shape)
    for k in range(len(offsets)):
        run = np.where((k > 0) & (stack[k] == stack[k - 1]), run + 1, 1)
        ends = (stack[k] >= 0) & ((stack[k] != stack[k + 1]) if k + 1 < len(offsets) else True)
        out += np.where(ends, run * np.log2(np.maximum(run, 1)), 0)
    return np.where(n > 0, np.log2(np.maximum(n, 1)) - out / np.maximum(n, 1), 0)


def distance_inside(mask: np.ndarray, most: int) -> np.ndarray:
    """Distance of each pixel of a mask from the nearest one outside it, up to ``most``; the image's edge is no outside."""
    big = float(most + 1)
    gap = np.where(mask, big, 0.0)
    for _ in range(2):
        for k in range(1, gap.shape[1]):
            gap[:, k] = np.minimum(gap[:, k], gap[:, k - 1] + 1)
        gap = gap[:, ::-1]
    out = np.full(mask.shape, big * big)
    p = np.pad(gap, ((most, most), (0, 0)), constant_values=big)
    for j in range(-most, most + 1):
        out = np.minimum(out, p[most + j : most + j + mask.shape[0]] ** 2 + j * j)
    return np.where(mask, np.minimum(np.sqrt(out), most), 0.0)


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Of each pixel of a mask the first pixel, row by row, that it is connected to (as y * width + x); -1 outside."""
    h, w = mask.shape
    up = np.where(mask, np.arange(h * w).reshape(h, w), -1).ravel()
    index = np.arange(h * w).reshape(h, w)
    a, b = [], []
    for j, i in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if diagonal else ())):
        one, two = (slice(0, h - j), slice(max(-i, 0), w - max(i, 0))), (slice(j, h), slice(max(i, 0), w - max(-i, 0)))
        both = mask[one] & mask[two]
        a.append(index[one][both])
        b.append(index[two][both])
    a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        while True:  # to the roots
            above = up[up]
            above[up < 0] = -1
            if (above == up).all():
                break
            up = above
        a, b = up[a], up[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(up, a, b)
    return up.reshape(h, w)


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, counter-clockwise where y points up."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def fill_rows(corners: np.ndarray) -> np.ndarray:
    """(y, first x, last x) of the whole pixels that a convex polygon covers, edges included."""
    if len(corners) < 3:
        x0, y0 = corners.min(axis=0)
        x1, y1 = corners.max(axis=0)
        ys = np.arange(int(np.ceil(y0)), int(np.floor(y1)) + 1)
        at = x0 + (ys - y0) * ((x1 - x0) / (y1 - y0) if y1 > y0 else 0)
        return np.array([[y, x0 if y1 == y0 else round(v), x1 if y1 == y0 else round(v)] for y, v in zip(ys, at, strict=True)], float).astype(int).reshape(-1, 3)
    rows = []
    for y in range(int(np.ceil(corners[:, 1].min())), int(np.floor(corners[:, 1].max())) + 1):
        xs = []
        for p, q in zip(corners, np.roll(corners, -1, axis=0), strict=True):
            if min(p[1], q[1]) <= y <= max(p[1], q[1]):
                xs += [p[0], q[0]] if p[1] == q[1] else [p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1])]
        rows.append((y, int(np.ceil(min(xs) - 1e-9)), int(np.floor(max(xs) + 1e-9))))
    return np.array(rows).reshape(-1, 3)


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex polygon within another one; no corners if they don't meet."""

    def area2(p: np.ndarray) -> float:
        x, y = p[:, 0], p[:, 1]
        return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())

    out = list(map(tuple, subject))
    window = window if area2(window) > 0 else window[::-1]
    for p, q in zip(window, np.roll(window, -1, axis=0), strict=True):
        side = [(q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) for r in out]
        new = []
        for k in range(len(out)):
            a, b, s, t = out[k - 1], out[k], side[k - 1], side[k]
            if (s < 0) != (t < 0):
                f = s / (s - t)
                new.append((a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))
            if t >= 0:
                new.append(b)
        out = new
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def otsu(values: np.ndarray, counts: np.ndarray, classes: int = 2) -> list[float]:
    """Thresholds (classes - 1 of them, 2 at most) that part a histogram with the largest variance between the parts."""
    n, s = np.cumsum(counts, dtype=float), np.cumsum(values * counts, dtype=float)
    if len(values) < classes:
        return [float(values[0])] * (classes - 1) if len(values) else [0.0] * (classes - 1)

    def part(n_: np.ndarray, s_: np.ndarray) -> np.ndarray:
        return np.divide(s_ * s_, n_, out=np.zeros(np.broadcast(n_, s_).shape), where=n_ > 0)

    if classes == 2:
        return [float(values[(part(n, s) + part(n[-1] - n, s[-1] - s))[:-1].argmax()])]
    i, j = np.triu_indices(len(values) - 1, 1)
    best = (part(n[i], s[i]) + part(n[j] - n[i], s[j] - s[i]) + part(n[-1] - n[j], s[-1] - s[j])).argmax()
    return [float(values[i[best]]), float(values[j[best]])]


def li(values: np.ndarray, counts: np.ndarray, rounds: int = 100) -> float:
    """The threshold of least cross entropy: it lies between the means of both sides as their logs say."""
    low = float(values.min())
    v = values - low
    t = float((v * counts).sum() / max(counts.sum(), 1))
    step = np.diff(np.unique(v)).min() / 2 if len(np.unique(v)) > 1 else 0.5
    for _ in range(rounds):
        above = v > t
        if not counts[above].sum() or not counts[~above].sum():
            break
        m1, m0 = np.average(v[above], weights=counts[above]), np.average(v[~above], weights=counts[~above])
        new = t if m0 <= 0 else float((m0 - m1) / (np.log(m0) - np.log(m1)))
        if m0 <= 0 or abs(new - t) < step:
            t = new
            break
        t = new
    return t + low


def noise(img: np.ndarray) -> float:
    """Standard deviation of an image's noise, from the differences of each two by two pixels."""
    d = img[:-1:2, :-1:2][: img.shape[0] // 2, : img.shape[1] // 2] - img[1::2, :-1:2] - img[:-1:2, 1::2] + img[1::2, 1::2] if min(img.shape) > 1 else np.zeros(1)
    return float(np.median(np.abs(d)) / 2 / 0.6744897501960817)


def gaussian_field(field: np.ndarray, sigma: float) -> np.ndarray:
    """Both parts of a field, smoothed."""
    return np.stack([gaussian(f, sigma) for f in field])

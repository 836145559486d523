"""Kernels over matched points: robust fits, leaf order, splines."""

from __future__ import annotations

import numpy as np


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3x3 matrix that takes src to dst in the least squares sense, from centred and scaled points."""
    if len(src) < 4:
        return None

    def normal(p: np.ndarray) -> np.ndarray:
        c = p.mean(axis=0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    t, u = normal(src), normal(dst)
    p, q = src @ t[:2, :2].T + t[:2, 2], dst @ u[:2, :2].T + u[:2, 2]
    x, y, one, zero = p[:, 0], p[:, 1], np.ones(len(p)), np.zeros((len(p), 3))
    base = np.stack([x, y, one], axis=1)
    rows = np.concatenate([np.concatenate([base, zero, -q[:, :1] * base], axis=1), np.concatenate([zero, base, -q[:, 1:] * base], axis=1)])
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    h = np.linalg.solve(u, h @ t)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def transfer_error(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    q = np.concatenate([src, np.ones((len(src), 1))], axis=1) @ h.T
    w = np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])
    return np.sqrt((((q[:, :2] / w) - dst) ** 2).sum(axis=1))


def ransac(src: np.ndarray, dst: np.ndarray, threshold: float = 7.0, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """Which matches agree with the homography that most agree with. Fewer than four all pass."""
    if len(src) < 4:
        return np.ones(len(src), bool)
    rng = np.random.default_rng(seed)
    best = np.zeros(len(src), bool)
    for _ in range(rounds):
        pick = rng.choice(len(src), 4, replace=False)
        h = fit_homography(src[pick], dst[pick])
        if h is None:
            continue
        ok = transfer_error(h, src, dst) < threshold
        if ok.sum() > best.sum():
            best = ok
            if best.all():
                break
    h = fit_homography(src[best], dst[best]) if best.sum() >= 4 else None
    return transfer_error(h, src, dst) < threshold if h is not None else best


def leaf_order(d: np.ndarray) -> list[int]:
    """Order of leaves of a single-linkage tree so that the sum of distances of neighbours is least.

    Clusters join by the edges of a least spanning tree. A cluster knows the cost of its best order for each pair of end
    leaves; that of two joined ones is a product of their tables with the distances between, in which sums take the place of
    products and the least the place of sums, so a join costs the cube of its size at most.
    """
    n = len(d)
    if n < 2:
        return list(range(n))
    near, via, left = d[0].astype(float).copy(), np.zeros(n, int), np.ones(n, bool)
    left[0], edges = False, []
    for _ in range(n - 1):
        k = int(np.where(left, near, np.inf).argmin())
        left[k] = False
        edges.append((near[k], min(int(via[k]), k), max(int(via[k]), k)))
        closer = left & (d[k] < near)
        near[closer], via[closer] = d[k][closer], k
    home = {i: i for i in range(n)}
    trees: dict[int, dict] = {i: {"leaves": np.array([i]), "cost": np.zeros((1, 1))} for i in range(n)}

    def least(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, place = np.empty((len(x), y.shape[1])), np.empty((len(x), y.shape[1]), int)
        for i in range(len(x)):
            sums = x[i][:, None] + y
            place[i] = sums.argmin(axis=0)
            value[i] = sums[place[i], np.arange(y.shape[1])]
        return value, place

    for _, i, j in sorted(edges):
        a, b = sorted((home[i], home[j]))
        p, q = trees.pop(a), trees.pop(b)
        mid, out_of = least(p["cost"], d[np.ix_(p["leaves"], q["leaves"])].astype(float))
        whole, into = least(mid, q["cost"])
        k, m = len(p["leaves"]), len(q["leaves"])
        cost = np.full((k + m, k + m), np.inf)
        cost[:k, k:], cost[k:, :k] = whole, whole.T
        trees[a] = {"leaves": np.concatenate([p["leaves"], q["leaves"]]), "cost": cost, "parts": (p, q), "out": out_of, "into": into}
        for x in trees[a]["leaves"]:
            home[int(x)] = a
    (tree,) = trees.values()

    def unroll(t: dict, first: int, last: int) -> list[int]:
        """The leaves of a tree in the best order from one end to the other."""
        stack, out = [(t, first, last)], []
        while stack:
            t, first, last = stack.pop()
            if len(t["leaves"]) == 1:
                out.append(int(t["leaves"][0]))
                continue
            p, q = t["parts"]
            k = len(p["leaves"])
            turned = first >= k
            x, y = (last, first - k) if turned else (first, last - k)
            enter = int(t["into"][x, y])
            leave = int(t["out"][x, enter])
            halves = [(p, x, leave), (q, enter, y)]
            # A turned tree is read from its other end.
            if turned:
                halves = [(q, y, enter), (p, leave, x)]
            stack += reversed(halves)
        return out

    best = np.argwhere(tree["cost"] == tree["cost"].min())
    orders = [unroll(tree, int(i), int(j)) for i, j in best[:64]]
    return min(orders)


def akima(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A smooth curve through points, of which the slopes follow their four neighbours; flat beyond the ends."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 3:
        return np.interp(at, x, y)
    m = np.diff(y) / np.diff(x)
    m = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    w1, w2 = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    s = w1 + w2
    t = np.where(s > 1e-12, (w1 * m[1:-2] + w2 * m[2:-1]) / np.where(s > 1e-12, s, 1), (m[1:-2] + m[2:-1]) / 2)
    at = np.clip(at, x[0], x[-1])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h, u = x[i + 1] - x[i], (at - x[i]) / (x[i + 1] - x[i])
    return (2 * u**3 - 3 * u**2 + 1) * y[i] + (u**3 - 2 * u**2 + u) * h * t[i] + (3 * u**2 - 2 * u**3) * y[i + 1] + (u**3 - u**2) * h * t[i + 1]


def farthest_points(values: np.ndarray, n: int) -> np.ndarray:
    """Indices of ``n`` rows, each the farthest from those before; the first is the farthest from the mean."""
    far = ((values - values.mean(axis=0)) ** 2).sum(axis=1)
    out = [int(far.argmax())]
    near = ((values - values[out[0]]) ** 2).sum(axis=1)
    while len(out) < min(n, len(values)):
        out.append(int(near.argmax()))
        near = np.minimum(near, ((values - values[out[-1]]) ** 2).sum(axis=1))
    return np.array(out)


def weighted_kmeans(values: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Centres of ``k`` clusters of weighted rows, from far points on."""
    centres = values[farthest_points(values, k)].astype(float)
    for _ in range(rounds):
        label = ((values[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(values[label == c], axis=0, weights=weights[label == c]) if (label == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def estimate_clusters(values: np.ndarray, weights: np.ndarray, most: int) -> int:
    """A number of clusters up to ``most``: where the spread within clusters bends most from its chord."""
    most = min(most, len(np.unique(values, axis=0)))
    if most < 2:
        return most
    spread = []
    for k in range(1, most + 1):
        c = weighted_kmeans(values, weights, k)
        spread.append(float((weights * ((values[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)).sum()))
    chord = np.interp(np.arange(most), [0, most - 1], [spread[0], spread[-1]])
    return int((chord - np.array(spread)).argmax()) + 1 if most > 2 else most


def sinkhorn(scores: np.ndarray, dustbin: float, rounds: int = 50) -> np.ndarray:
    """Log assignment of rows to columns with a bin for those without a partner, by alternate normalisation."""
    m, n = scores.shape
    z = np.full((m + 1, n + 1), dustbin)
    z[:m, :n] = scores
    norm = -np.log(m + n)
    mu, nu = np.full(m + 1, norm), np.full(n + 1, norm)
    mu[-1] += np.log(n)
    nu[-1] += np.log(m)
    lse = lambda a, axis: np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis)) + a.max(axis=axis)
    u, v = np.zeros(m + 1), np.zeros(n + 1)
    for _ in range(rounds):
        u = mu - lse(z + v[None], 1)
        v = nu - lse(z + u[:, None], 0)
    return z + u[:, None] + v[None] - norm


def assigned(a: np.ndarray, b: np.ndarray, sharpness: float, dustbin: float, rounds: int, held: int = 1 << 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best column, its score, best row of each column, its score) of what ``sinkhorn`` makes of ``sharpness`` times the products of
    the rows of ``a`` and of ``b``, unit vectors all.

    Weights of rows are worked out block by block, and those of columns from the same blocks, so a round takes one pass; of more
    than ``held`` products none are kept between passes, and memory is that of a block.
    """
    m, n = len(a), len(b)
    most = sharpness  # no product is larger, so that none of the powers is above 1
    bin_ = np.exp(sharpness * dustbin - most)
    step = max(1, min(m, (held >> 3) // max(n, 1)))
    power = lambda lo: np.exp(sharpness * (a[lo : lo + step] @ b.T) - most)
    kept = [power(lo) for lo in range(0, m, step)] if m * n <= held else None
    blocks = lambda: ((lo, kept[k] if kept else power(lo)) for k, lo in enumerate(range(0, m, step)))
    u, v, un, vm = np.zeros(m), np.ones(n), 0.0, 1.0  # of the rows, the columns and the bins
    for _ in range(rounds):
        total = np.zeros(n)
        for lo, k in blocks():
            u[lo : lo + step] = 1 / (k @ v + bin_ * vm)
            total += u[lo : lo + step] @ k
        un = n / (bin_ * (v.sum() + vm))
        old, v, vm = v, 1 / (total + bin_ * un), m / (bin_ * (u.sum() + un))
        if np.allclose(v, old, rtol=1e-15, atol=0):
            break
    best, score, back, reverse = np.zeros(m, np.int64), np.zeros(m), np.zeros(n, np.int64), np.full(n, -1.0)
    for lo, k in blocks():
        z = u[lo : lo + step, None] * k * v[None]
        best[lo : lo + step], score[lo : lo + step] = z.argmax(axis=1), z.max(axis=1)
        top, value = z.argmax(axis=0), z.max(axis=0)
        more = value > reverse
        back[more], reverse[more] = lo + top[more], value[more]
    return best, score, back, reverse

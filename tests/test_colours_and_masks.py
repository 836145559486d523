"""Colour spaces, stains and masks against NumPy and against what they are made from."""

import numpy as np
import pandas as pd
import pytest

from tilewright.functions import colour as C
from tilewright.kernels import colour as K
from tilewright.kernels import images as I
from tilewright.operators import masks as Mk
from tilewright.operators import raster as P
from tilewright.operators import stain as S

RGB = ["r0", "g0", "b0"]


def table(spark, img, names=RGB, image=0):
    """Pixels of an array (h, w, bands)."""
    img = img[..., None] if img.ndim == 2 else img
    y, x = np.mgrid[: img.shape[0], : img.shape[1]]
    t = pd.DataFrame({"image": image, "x": x.ravel(), "y": y.ravel(), **{n: img[..., k].ravel() for k, n in enumerate(names)}})
    return spark.createDataFrame(t).selectExpr("cast(image as int) image", "cast(x as int) x", "cast(y as int) y", *names)


def array(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def mask_table(spark, mask, image=0):
    ys, xs = np.nonzero(mask)
    return spark.createDataFrame([(image, int(x), int(y)) for x, y in zip(xs, ys, strict=True)], "image int, x int, y int")


def mask_array(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r.y, r.x] = True
    return out


@pytest.fixture(scope="module")
def tissue():
    """A light slide with a purple and a pink blot, a dark hair and a speck."""
    rng = np.random.default_rng(0)
    img = np.full((60, 70, 3), 235.0)
    y, x = np.mgrid[:60, :70]
    one, two = (x - 22) ** 2 + (y - 28) ** 2 < 144, (x - 50) ** 2 + (y - 38) ** 2 < 100
    img[one], img[two] = (120, 70, 150), (210, 120, 160)
    img[5:7] = 60
    img += rng.normal(0, 3, img.shape)
    return np.clip(img, 0, 255).astype(int), one | two


@pytest.mark.parametrize("space", K.SPACES)
def test_spaces_as_columns(spark, space):
    img = np.random.default_rng(1).integers(0, 256, (8, 9, 3))
    p = table(spark, img)
    jab = C.rgb_to_jab(p, RGB, space)
    want = K.rgb_to_jab(img / 255, space)
    for k, c in enumerate("jab"):
        assert np.allclose(array(jab, c, img.shape[:2]), want[..., k], atol=1e-9)
    back = C.jab_to_rgb(jab, ["j", "a", "b"], space)
    for k, c in enumerate("rgb"):
        assert np.allclose(array(back, c, img.shape[:2]) * 255, img[..., k], atol=1e-4)
    assert np.allclose(K.from_polar(K.to_polar(want, 40.0), 40.0), want)
    with pytest.raises(ValueError):
        C.rgb_to_jab(p, RGB, "none")


def test_stains_are_told_apart(spark):
    rng = np.random.default_rng(2)
    stains = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]])
    amount = rng.uniform(0, 1.4, (30, 40, 2))
    img = np.clip(240 * np.exp(-(amount @ stains)) - 1, 0, 255).astype(int)
    p = table(spark, img)
    v = np.array(S.stain_vectors(p, RGB).first().vectors).reshape(2, 3)
    unit = stains / np.linalg.norm(stains, axis=1, keepdims=True)
    assert np.abs(np.abs(v) @ unit.T - np.eye(2) - (1 - np.eye(2)) * (unit[0] @ unit[1])).max() < 0.05 and v[0, 0] > v[1, 0]
    c = S.stain_concentrations(p, RGB, S.stain_vectors(p, RGB))
    first, second = array(c, "first", img.shape[:2]), array(c, "second", img.shape[:2])
    assert np.corrcoef(first.ravel(), amount[..., 0].ravel())[0, 1] > 0.97 and np.corrcoef(second.ravel(), amount[..., 1].ravel())[0, 1] > 0.97
    assert abs(np.percentile(first, 99) - 1.9705) < 1e-6
    hem = array(S.haematoxylin_eosin(p, RGB, "hem"), "v", img.shape[:2])
    assert np.allclose(hem, np.clip(240 * first, 0, 255))
    d = K.unmixing_matrix(255 * 10 ** -np.array([[0.8, 0.5, 0.1], [0.1, 0.9, 0.3]]))
    got = S.unmix(p, RGB, d)
    od = np.maximum(-np.log10(img / 255 + K.EPS), 0) @ d
    assert np.allclose(array(got, "stain2", img.shape[:2]), od[..., 1])
    flat = array(S.flatten_stains(p, RGB, 6), "v", img.shape[:2])
    assert flat.min() == 0 and flat.max() == 255
    whole = p.where("x < 3")
    assert S.flatten_stains(p, RGB, 6, mask=whole.select("image", "x", "y")).count() == 1200


def test_dominant_colours_and_quantising(spark, tissue):
    img, _ = tissue
    p = table(spark, img)
    c = S.dominant_colours(p, RGB, n=3, least_colourfulness=0.0)
    q = S.quantise(p, RGB, c)
    rows = q.collect()
    assert len(rows) == 60 * 70 and len({r.colour for r in rows}) == 3
    at = {(r.x, r.y): r.colour for r in rows}
    assert at[22, 28] != at[50, 38] != at[2, 50] and at[22, 28] != at[2, 50]
    auto = S.dominant_colours(p, RGB, most=5)
    assert 1 <= auto.count() <= 5
    hues = S.dominant_hues(p, RGB).orderBy("rank").collect()
    assert hues and [h.rank for h in hues] == list(range(1, len(hues) + 1)) and all(a.n >= b.n for a, b in zip(hues, hues[1:], strict=False))
    s = S.colour_similarity(p, RGB, [(120, 70, 150), (210, 120, 160)], "norm")
    assert {r.image for r in s.where("colour1 > 0.99").collect()} == {0}


def test_lightness_and_background(spark, tissue):
    img, on = tissue
    p = table(spark, img)
    for d in (S.background_distance(p, RGB), S.lightness_colourfulness_distance(p, RGB, metric="chebyshev"), S.lightness_colourfulness_distance(p, RGB, space="CAM16UCS")):
        a = array(d, "d", on.shape)
        assert a[on].mean() > 3 * a[~on].mean()
    lum = array(S.luminosity(p, RGB), "v", on.shape)
    assert lum[on].mean() > lum[20:, :5].mean() + 50
    flat = array(S.standardise_colourfulness(p, RGB), "v", on.shape)
    assert flat.min() == 0 and flat.max() == 255 and flat[on].mean() > flat[20:, :5].mean()


def test_tissue_masks(spark, tissue):
    img, on = tissue
    p = table(spark, img)
    found = mask_array(Mk.tissue_rgb(p, RGB), on.shape)
    assert (found & on).sum() > 0.95 * on.sum() and (found & ~on).sum() < 0.02 * on.size
    mask, hull = Mk.tissue_lightness_colourfulness(p, RGB)
    a, b = mask_array(mask, on.shape), mask_array(hull, on.shape)
    assert (a & on).sum() > 0.8 * on.sum() and not (a & ~b).any()
    assert mask_array(Mk.tissue_multichannel(p, RGB, filled=True), on.shape).mean() > 0.9


def test_components_across_tiles(spark):
    mask = np.random.default_rng(3).random((40, 50)) < 0.45
    for diagonal in (True, False):
        want = I.label(mask, diagonal)
        got = {(r.x, r.y): r.comp for r in P.components(mask_table(spark, mask), diagonal, tile=7).collect()}
        assert got == {(int(x), int(y)): (int(want[y, x]) // 50 << 32) + int(want[y, x]) % 50 for y, x in np.argwhere(mask)}
    big = spark.createDataFrame([(0, (1 << 22) + k, (1 << 21)) for k in range(3)], "image int, x int, y int")
    assert {r.comp for r in P.components(big).collect()} == {((1 << 21) << 32) + (1 << 22)}


def flood(mask, diagonal):
    """Labels by walking."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            j, i = todo.pop()
            if 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and mask[j, i] and not out[j, i]:
                out[j, i] = n
                todo += [(j + a, i + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or abs(a) + abs(b) == 1]
    return out


def test_labels_holes_and_hulls(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((25, 30)) < 0.6
    for diagonal in (True, False):
        a, b = I.label(mask, diagonal), flood(mask, diagonal)
        assert len(set(zip(a[mask], b[mask], strict=True))) == len(set(a[mask])) == len(set(b[mask]))
    frame = spark.createDataFrame([(0, 30, 25)], "image int, w int, h int")
    out = flood(~mask, False)
    edge = set(out[0]) | set(out[-1]) | set(out[:, 0]) | set(out[:, -1])
    want = mask | ~np.isin(out, list(edge))
    assert (mask_array(Mk.fill_holes(mask_table(spark, mask), frame, tile=8), mask.shape) == want).all()
    blob = np.zeros((25, 30), bool)
    blob[3:10, 4:9] = True
    blob[15, 15], blob[16, 16], blob[20, 3:28] = True, True, True
    regions = P.components(mask_table(spark, blob))
    hulls = {r.area: r.hull_area for r in Mk.hulls(regions).collect()}
    assert hulls == {35: 35, 2: 2, 25: 25}
    ring = np.zeros((25, 30), bool)
    ring[5:15, 5:15] = True
    ring[7:13, 7:15] = False
    kept = mask_array(Mk.irregular_regions(mask_table(spark, blob | ring)), ring.shape)
    assert not kept[20].any()
    h = mask_array(Mk.hull_mask(mask_table(spark, ring)), ring.shape)
    assert h[5:15, 5:15].all() and h.sum() == 100


def test_boxes_edges_and_sizes(spark):
    m = np.zeros((40, 40), bool)
    m[2:6, 2:6], m[5, 8:20], m[30:34, 30:34], m[12:20, 6] = True, True, True, True
    boxes = {(r.x0, r.y0, r.x1, r.y1) for r in Mk.box_mask(mask_table(spark, m), cell=8).collect()}
    assert boxes == {(2, 2, 5, 5), (8, 5, 19, 5), (30, 30, 33, 33), (6, 12, 6, 19)}
    m[5, 6:8] = True
    m[6:12, 19] = True
    merged = {(r.x0, r.y0, r.x1, r.y1) for r in Mk.box_mask(mask_table(spark, m), cell=8).collect()}
    assert (30, 30, 33, 33) in merged and (2, 2, 19, 11) in merged or (2, 2, 19, 19) in merged
    frame = spark.createDataFrame([(0, 40, 40)], "image int, w int, h int")
    m[0, 0] = True
    edge = {(r.x, r.y) for r in Mk.by_edge(mask_table(spark, m), frame).where("edge").collect()}
    assert edge == {(0, 0)}
    large = mask_array(Mk.large_regions(mask_table(spark, m), of_largest=0.9), m.shape)
    assert large[5, 10] and not large[31, 31]
    assert mask_array(Mk.large_regions(mask_table(spark, m), of_frame=(frame, 0.5)), m.shape)[5, 10]


def test_thresholds_and_tiled_kernels(spark):
    rng = np.random.default_rng(5)
    img = np.concatenate([rng.normal(20, 3, 900), rng.normal(100, 4, 500), rng.normal(200, 5, 300)]).clip(0, 255).reshape(34, 50)
    p = table(spark, img, ["v"])
    two = Mk.thresholds(p, "v", "multiotsu").first()
    assert 26 < two.low < 90 and 105 < two.high < 190
    assert 26 < Mk.thresholds(p, "v").first().low < 190 and 20 < Mk.thresholds(p, "v", "li").first().low < 150
    top = array(Mk.remove_background(p, "v", 2, tile=11), "v", img.shape)
    assert np.allclose(top, img - I.opening(img, I.disk(2)))
    want = I.total_variation(img, 0.3, 12)
    got = array(Mk.denoise(p, "v", 0.3, rounds=12, tile=13), "v", img.shape)
    assert np.abs(got - np.floor((want - want.min()) / (want.max() - want.min()) * 255)).max() <= 1
    thick = np.zeros((40, 60), bool)
    thick[5:25, 5:25], thick[30, 2:58] = True, True
    assert (mask_array(Mk.without_thin_parts(mask_table(spark, thick), 12), thick.shape)[30] == 0).all()
    d = I.distance_inside(thick, 12)
    y, x = np.argwhere(~thick).T
    for j, i in ((5, 5), (15, 15), (10, 20), (30, 30)):
        assert abs(d[j, i] - min(12, np.sqrt(((y - j) ** 2 + (x - i) ** 2).min()))) < 1e-9
    grey = rng.integers(0, 4, (12, 13)) * 60
    e = I.local_entropy(grey, 2)
    near = [grey[6 + j, 6 + i] for j, i in I.disk(2)]
    q = np.unique(near, return_counts=True)[1] / len(near)
    assert abs(e[6, 6] + (q * np.log2(q)).sum()) < 1e-9


def test_outlines_close_at_edges(spark):
    m = np.zeros((30, 30), bool)
    m[0:10, 5], m[0:10, 15], m[9, 5:16] = True, True, True
    frame = spark.createDataFrame([(0, 30, 30)], "image int, w int, h int")
    got = mask_array(Mk.filled_outlines(mask_table(spark, m), frame, 1), m.shape)
    assert got[2, 10] and not got[20, 20]


def test_adaptive_equalising(spark):
    rng = np.random.default_rng(11)
    img = np.clip(rng.normal(90, 20, (41, 53)) + np.linspace(0, 60, 53), 0, 255).astype(int)
    got = array(P.equalise_adaptive(table(spark, img, ["v"]), "v", regions=4, clip=0.02), "v", img.shape)
    rh, rw = 11, 14
    maps = {}
    for j in range(4):
        for i in range(4):
            n = np.bincount(img[j * rh : (j + 1) * rh, i * rw : (i + 1) * rw].ravel(), minlength=256).astype(float)
            limit = max(0.02 * n.sum(), 1)
            n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256
            maps[i, j] = np.cumsum(n) / n.sum() * 255
    for y, x in ((0, 0), (5, 7), (20, 30), (40, 52), (11, 13), (33, 3)):
        gx, gy = (x + 0.5) / rw - 0.5, (y + 0.5) / rh - 0.5
        i, j = int(np.floor(gx)), int(np.floor(gy))
        at = lambda a, b: maps[min(max(a, 0), 3), min(max(b, 0), 3)][img[y, x]]  # noqa: E731, B023
        want = (at(i, j) * (1 - gx + i) + at(i + 1, j) * (gx - i)) * (1 - gy + j) + (at(i, j + 1) * (1 - gx + i) + at(i + 1, j + 1) * (gx - i)) * (gy - j)
        assert abs(got[y, x] - want) < 1e-9
    assert np.isfinite(got).all() and got.std() > img.std()

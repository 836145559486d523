"""Kernels by their invariants."""

import itertools

import numpy as np

from tilewright.kernels import images as I
from tilewright.kernels import points as K

RNG = np.random.default_rng(11)


def blobs(h=64, w=72):
    return I.gaussian(RNG.random((h, w)) * 255, 2.0)


def test_ransac_finds_planted_inliers():
    src = RNG.random((60, 2)) * 500
    h = np.array([[1.1, 0.1, 20], [-0.1, 0.95, -7], [1e-5, 2e-5, 1]])
    q = np.c_[src, np.ones(60)] @ h.T
    dst = q[:, :2] / q[:, 2:]
    dst[40:] += RNG.random((20, 2)) * 200 + 50
    ok = K.ransac(src, dst)
    assert ok[:40].all() and not ok[40:].any()
    assert K.ransac(src[:3], dst[:3]).all()


def test_leaf_order_is_the_best_for_small_trees():
    x = np.array([0.0, 5.0, 1.0, 6.0, 2.1])
    d = np.abs(x[:, None] - x[None])
    order = K.leaf_order(d)
    cost = sum(d[a, b] for a, b in itertools.pairwise(order))
    assert sorted(order) == list(range(5)) and np.isclose(cost, 6.0)
    assert K.leaf_order(np.zeros((1, 1))) == [0]


def test_akima_goes_through_its_points():
    x, y = np.array([0.0, 1, 2, 4, 7]), np.array([0.0, 2, 1, 5, 5])
    assert np.allclose(K.akima(x, y, x), y)
    assert np.allclose(K.akima(x, 2 * x + 1, np.linspace(0, 7, 20)), 2 * np.linspace(0, 7, 20) + 1)
    assert K.akima(x, y, np.array([-5.0, 99]))[1] == 5


def test_sinkhorn_marginals():
    z = np.exp(K.sinkhorn(RNG.normal(size=(4, 6)), 0.5, 200))
    assert np.allclose(z[:4].sum(axis=1), 1, atol=1e-3) and np.allclose(z[:, :6].sum(axis=0), 1, atol=1e-3)


def test_clusters():
    v = np.concatenate([RNG.normal(c, 0.1, (50, 2)) for c in (0, 5, 10)])
    c = K.weighted_kmeans(v, np.ones(150), 3)
    assert np.allclose(sorted(c[:, 0]), [0, 5, 10], atol=0.2)


def test_sampling():
    img = blobs()
    yy, xx = np.mgrid[:64, :72].astype(float)
    assert np.allclose(I.sample_bilinear(img, xx, yy), img) and np.allclose(I.sample_bicubic(img, xx, yy), img)
    ramp = 3 * xx + 2 * yy
    x, y = RNG.uniform(2, 60, 50), RNG.uniform(2, 60, 50)
    assert np.allclose(I.sample_bilinear(ramp, x, y), 3 * x + 2 * y) and np.allclose(I.sample_bicubic(ramp, x, y), 3 * x + 2 * y)
    shift = np.array([[1, 0, 3], [0, 1, -2], [0, 0, 1.0]])
    assert np.allclose(I.warp(img, shift, img.shape)[10:50, 10:50], img[8:48, 13:53]) and np.allclose(I.warp(img, shift, img.shape, order=0)[10:50, 10:50], img[8:48, 13:53])


def test_flow_recovers_a_shift():
    img = blobs(96, 96)
    field = I.optical_flow(img, np.roll(img, 2, axis=1), rounds=200)
    assert abs(np.median(field[0][16:-16, 16:-16]) - 2) < 0.6 and abs(np.median(field[1][16:-16, 16:-16])) < 0.4


def test_inverse_field_undoes_a_field():
    yy, xx = np.mgrid[:40, :40].astype(float)
    f = np.stack([2 * np.sin(yy / 9), 1.5 * np.cos(xx / 8)])
    v = I.invert_field(f, 40)
    x, y = np.clip(xx + v[0], 0, 39), np.clip(yy + v[1], 0, 39)
    back = np.stack([x + I.sample_bilinear(f[0], x, y), y + I.sample_bilinear(f[1], x, y)])
    assert np.abs(back - np.stack([xx, yy]))[:, 5:-5, 5:-5].max() < 0.05


def test_corners_and_masks():
    img = np.zeros((40, 40))
    img[10:20, 12:25] = 100
    xy, r = I.harris(img, 4)
    assert {(round(x / 13), round(y / 10)) for x, y in xy} == {(1, 1), (2, 1), (1, 2), (2, 2)} and (np.diff(r) <= 0).all()
    d = I.patch_descriptors(img, xy)
    assert np.allclose((d * d).sum(axis=1), 1)
    m = np.zeros((9, 9), bool)
    m[4, 4] = True
    assert I.dilate(m, 2).sum() == 13
    assert (img + np.arange(40) * 0.01 - I.opening(img + np.arange(40) * 0.01, I.disk(8))).max() > 90 and (I.opening(np.ones((20, 20)), I.disk(3)) == 1).all()
    noisy = img + RNG.normal(0, 5, img.shape)
    assert np.abs(I.total_variation(noisy, 10) - img).mean() < np.abs(noisy - img).mean()

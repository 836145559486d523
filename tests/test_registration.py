"""Matching, chains, refinement and whole stacks, on planted images and points."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.kernels import descriptors as X
from tilewright.kernels import images as I
from tilewright.kernels import optimise as O
from tilewright.kernels import points as K
from tilewright.operators import estimate as E
from tilewright.operators import grouped as G
from tilewright.operators import matching as M
from tilewright.operators import register as N
from tilewright.operators import tiles as T
from tilewright.plans import q_register, q_warp
from tilewright.plans import views as V
from tilewright.plans.registrar import REGISTRY, Registrar, register_function


@pytest.mark.parametrize("metric", X.METRICS)
def test_nearest_descriptors(spark, metric):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (40, 6)).astype(float) + 1, rng.integers(0, 3, (50, 6)).astype(float) + 1  # with many ties
    whole = X.exact(a[:, None], b[None], metric)
    j, d, second = X.two_nearest(a, b, metric, block=7)
    rounded = np.round(whole, 12)
    assert (rounded[np.arange(40), j] == rounded.min(axis=1)).all() and np.allclose(second, np.sort(whole, axis=1)[:, 1])
    assert metric == "cosine" or (j == whole.argmin(axis=1)).all()
    kp = spark.createDataFrame([(0, k, 0.0, 0.0, x.tolist()) for k, x in enumerate(a)] + [(1, k, 0.0, 0.0, x.tolist()) for k, x in enumerate(b)], "image int, kp int, x double, y double, descr array<double>")
    pairs = M.neighbour_pairs(kp)
    for how in ({}, {"cross_check": False, "max_ratio": 0.9}, {"max_distance": float(np.median(d))}):
        got = {(r.i, r.j, round(r.d, 9)) for r in M.match_pairs(kp, pairs, metric, **how).collect()}
        want = {(r.i, r.j, round(r.d, 9)) for r in M.nearest(M.pair_distances(kp, pairs, metric), **how).collect()}
        assert got == want or metric == "cosine" and len(got ^ want) <= 4


def test_matching_of_thousands(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(7500, 64))
    b = a[::-1] + rng.normal(size=a.shape) * 0.05
    i, j, d = X.match(a, b)
    assert len(i) == 7500 and (j == 7499 - i).all() and d.max() < 1


def test_assignment(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(30, 16))
    b = np.concatenate([a[::-1][:25] + rng.normal(size=(25, 16)) * 0.1, rng.normal(size=(10, 16))])
    kp = spark.createDataFrame([(k, n, 0.0, 0.0, x.tolist()) for k, d in ((0, a), (1, b)) for n, x in enumerate(d)], "image int, kp int, x double, y double, descr array<double>")
    got = {(r.i, r.j) for r in M.assigned_pairs(kp, M.neighbour_pairs(kp), 0.5).collect()}
    assert got == {(29 - k, k) for k in range(25)}


def flips(tree):
    if isinstance(tree, int):
        return [[tree]]
    return [p + q for x, y in (tree, tree[::-1]) for p in flips(x) for q in flips(y)]


def test_leaf_order_is_the_best_of_its_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 7):
        p = rng.random((n, 3))
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        clusters = {i: i for i in range(n)}
        members = {i: [i] for i in range(n)}
        while len(clusters) > 1:
            a, b = min(itertools.combinations(clusters, 2), key=lambda q: min(d[x, y] for x in members[q[0]] for y in members[q[1]]))
            clusters[a], members[a] = (clusters[a], clusters.pop(b)), members[a] + members.pop(b)
        cost = lambda o: sum(d[x, y] for x, y in zip(o, o[1:], strict=False))
        order = K.leaf_order(d)
        assert sorted(order) == list(range(n)) and cost(order) == pytest.approx(min(map(cost, flips(clusters[0]))))
    line = np.random.default_rng(3).permutation(300).astype(float)
    assert (np.abs(np.diff(line[K.leaf_order(np.abs(line[:, None] - line[None]))])) == 1).all()


def matrix(a, b, tx, ty):
    return np.array([[a, -b, tx], [b, a, ty], [0, 0, 1.0]])


def test_chains_to_a_reference(spark):
    rng = np.random.default_rng(4)
    ms = {k: matrix(*rng.normal(size=4)) for k in range(9)}
    steps = [("s", k, k + 1 if k < 4 else k - 1, ms[k].ravel().tolist()) for k in range(9) if k != 4] + [("t", 1, 0, ms[1].ravel().tolist())]
    t = spark.createDataFrame(steps, "stack string, image int, fixed int, m array<double>")
    got = {(r.stack, r.image): np.array(r.m).reshape(3, 3) for r in E.chain_to_reference(t, "stack").collect()}
    assert set(got) == {("s", k) for k in range(9)} | {("t", 0), ("t", 1)}
    want = np.eye(3)
    for k in (5, 6, 7, 8):
        want = ms[k] @ want
        assert np.allclose(got["s", k], want)
    assert np.allclose(got["s", 1], ms[1] @ ms[2] @ ms[3]) and np.allclose(got["s", 4], np.eye(3)) and np.allclose(got["t", 1], ms[1])
    assert E.chain_to_reference(t.where("false"), "stack").count() == 0


def planted(spark, n=60, outliers=15, noise=0.3, seed=5, pairs=((1, 0), (2, 1))):
    """Matches of images under known matrices, some of them wrong."""
    rng = np.random.default_rng(seed)
    ms, rows = {}, []
    for one, two in pairs:
        ms[one, two] = m = matrix(1.05 * np.cos(0.1 * one), 1.05 * np.sin(0.1 * one), 5.0 * one, -3.0)
        p = rng.uniform(0, 500, (n, 2))
        q = p @ m[:2, :2].T + m[:2, 2] + rng.normal(0, noise, p.shape)
        q[:outliers] = rng.uniform(0, 500, (outliers, 2))
        rows += [(one, two, k, k, *map(float, (*q[k], *p[k]))) for k in range(n)]
    return spark.createDataFrame(rows, "image1 int, image2 int, i int, j int, x1 double, y1 double, x2 double, y2 double"), ms


def test_filters_find_what_agrees(spark):
    m, _ = planted(spark)
    kept = {(r.image1, r.i) for r in E.filter_matches(m, "ransac", 3.0).collect()}
    assert all(i >= 15 for _, i in kept) and len(kept) > 80
    gms = E.filter_matches(m, "gms", grid=(125.0, 1.0)).count()
    assert 0 < gms <= 120
    with pytest.raises(ValueError):
        E.filter_matches(m, "none")
    few = m.where("i < 3")
    assert E.filter_matches(few, "ransac").count() >= 4


def test_rematching(spark):
    good, _ = planted(spark, 80, 0)
    old = planted(spark, 60, 40)[0].where("image1 = 1").unionByName(good.where("image1 = 2 AND i < 60"))
    worse = good.where("i < 10").withColumn("x1", F.col("x1") + F.col("i") * F.col("i") * 60 % 700)
    got = E.rematch(old, good.where("image1 = 1").unionByName(worse.where("image1 = 2")), 5.0)
    n = {r.image1: r["count"] for r in got.groupBy("image1").count().collect()}
    assert n == {1: 80, 2: 60}
    merged = E.rematch(old, good.where("i < 50"), 5.0)
    assert {r.image1: r["count"] for r in merged.groupBy("image1").count().collect()}[1] > 50


def test_neighbours_and_subsets(spark):
    m, _ = planted(spark, 60, 0)
    both = M.both_ways(m)
    near = M.cell_neighbours(both, 100.0)
    assert 0 < near.count() < both.count() and {r.image1 for r in near.collect()} == {1}
    sub = M.better_subset(m, m.where("i >= 30").unionByName(m.where("i < 2").limit(0)))
    assert sub.count() in (60, 90, 120)
    order = spark.createDataFrame([(0, 0), (1, 2), (2, 1)], "image int, place int")
    assert {(r.image1, r.image2) for r in M.neighbours_only(m, order).select("image1", "image2").distinct().collect()} == {(2, 1)}
    mask = spark.createDataFrame([(k, x, y) for k in range(3) for x in range(250) for y in range(250)], "image int, x int, y int")
    inside = M.in_mask(m, mask).collect()
    assert inside and all(max(r.x1, r.y1, r.x2, r.y2) <= 249.5 for r in inside) and len(inside) == sum(1 for r in m.collect() if max(r.x1, r.y1, r.x2, r.y2) < 249.5 and min(r.x1, r.y1) >= -0.5)


def test_settling_lowers_errors(spark):
    m, ms = planted(spark, 80, 0, 0.1)
    off = spark.createDataFrame([(0, np.eye(3).ravel().tolist()), (1, (matrix(1, 0.01, 4, -2) @ np.linalg.inv(matrix(1, 0, 0, 0)) @ ms[1, 0]).ravel().tolist()), (2, (ms[2, 1] @ matrix(0.98, 0, 3, 3) @ ms[1, 0]).ravel().tolist())], "image int, m array<double>")
    order = spark.createDataFrame([(1, 0), (2, 1)], "image int, fixed int")
    before = {r.image1: r.rigid_d for r in N.stack_errors(m, off).collect()}
    after = {r.image1: r.rigid_d for r in N.stack_errors(m, E.settle(m, off, order)).collect()}
    assert all(after[k] < 0.3 < before[k] for k in (1, 2))


def picture(h=120, w=140, seed=0):
    return I.gaussian(np.random.default_rng(seed).random((h, w)) * 255, 2.5) * 3 % 256


def stack_pixels(spark, images):
    rows = []
    for k, img in enumerate(images):
        y, x = np.mgrid[: img.shape[0], : img.shape[1]]
        rows.append(pd.DataFrame({"image": k, "x": x.ravel(), "y": y.ravel(), "v": img.ravel()}))
    return spark.createDataFrame(pd.concat(rows)).selectExpr("cast(image as int) image", "cast(x as int) x", "cast(y as int) y", "v")


def test_costs_and_alignment(spark):
    fixed = I.gaussian(np.random.default_rng(8).random((96, 96)) * 255, 3.0)
    fixed = (fixed - fixed.min()) / (fixed.max() - fixed.min()) * 255
    true = O.rigid(np.array([0.04, 3.0, -2.0]), fixed.shape, False)
    moving = I.warp(fixed, np.linalg.inv(true), fixed.shape, fill=float(fixed.mean()))
    inside = np.ones(fixed.shape, bool)
    for name, cost in O.COSTS.items():
        if name != "displacement":
            assert cost(fixed, fixed, inside) < cost(fixed, picture(96, 96, 3), inside), name
    for cost in ("mse", "nmi"):
        m, before, after = O.align(fixed, moving, cost=cost)
        corner = np.array([[10, 10, 1], [80, 15, 1], [40, 80, 1.0]]).T
        assert after < before and np.abs((m - true) @ corner).max() < 1.5, cost
    h = O.partial_volume(fixed, moving, true, 16)
    assert h.sum() <= fixed.size + 1e-6 and O.entropy((h / h.sum()).ravel()) < O.entropy((O.partial_volume(fixed, moving, np.eye(3), 16) / fixed.size).ravel())
    exact = O.partial_volume(fixed, fixed, np.eye(3), 16)
    assert np.allclose(exact, np.diag(np.diag(exact))) and exact.sum() == fixed.size
    x, y, v = O.off_grid(fixed, 3.0)
    assert np.allclose(v, I.sample_bilinear(fixed, x, y)) and len(v) == 32 * 32
    same, before, after = O.align(fixed, fixed, cost="mse")
    assert np.allclose(same, np.eye(3)) and before == after
    p = stack_pixels(spark, [fixed, moving])
    pairs = spark.createDataFrame([(1, 0, np.eye(3).ravel().tolist())], "image1 int, image2 int, m array<double>")
    got = N.optimise_pairs(p, "v", pairs, "mse")
    r = got.first()
    assert r.after < r.before and np.abs((np.array(r.m).reshape(3, 3) - true)[:2, :2]).max() < 0.02
    taken = N.refine(pairs, got).first()
    assert np.allclose(taken.m, r.m)
    bad = spark.createDataFrame([(1, 0, k, k, float(k), float(k * k % 50), float(k), float(k * k % 50)) for k in range(20)], "image1 int, image2 int, i int, j int, x1 double, y1 double, x2 double, y2 double")
    assert np.allclose(N.refine(pairs, got, bad).first().m, np.eye(3).ravel())


def bent(img, seed):
    f = np.stack([I.gaussian(np.random.default_rng(seed + k).normal(size=img.shape), 12.0) * 60 for k in (0, 1)])
    return I.warp(img, np.eye(3), img.shape, f, fill=float(img.mean()))


def gap(p, images, ref):
    a = {k: np.zeros((120, 140)) for k in images}
    for r in p.collect():
        if r.image in a:
            a[r.image][r.y, r.x] = r.v
    return {k: float(np.abs(a[k] - ref)[10:-10, 10:-10].mean()) for k in images}


@pytest.mark.parametrize("way", ["serial", "reference", "groupwise"])
def test_fields_bring_images_together(spark, way):
    base = picture()
    images = [bent(base, 10), base, bent(base, 20), bent(base, 30)]
    p = stack_pixels(spark, images)
    calc = lambda t: G.flow(t, "fixed", "moving", 64, 24)
    if way == "serial":
        steps = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (3, 2, 1)], "moving int, fixed int, step int")
        f = N.register_serial(p, steps, "v", calc)
    elif way == "reference":
        f = N.register_to_reference(p, 1, "v", calc)
    else:
        f = N.register_groupwise(p, "v", 2, calc)
    moved = N.warp_by_field(p, f, "v")
    if way == "groupwise":
        spread = lambda t: t.where("x between 10 and 129 and y between 10 and 109").groupBy("x", "y").agg(F.stddev("v").alias("s")).agg(F.avg("s")).first()[0]
        assert spread(moved) < 0.8 * spread(p)
    else:
        before, after = gap(p, (0, 2, 3), base), gap(moved, (0, 2, 3), base)
        assert all(after[k] < 0.8 * before[k] for k in before), (before, after)
    assert N.register_serial(p, spark.createDataFrame([], "moving int, fixed int, step int"), "v").count() == 0


def test_masks_hold_fields(spark):
    base = picture()
    p = stack_pixels(spark, [bent(base, 10), base])
    mask = spark.createDataFrame([(x, y) for x in range(40, 90) for y in range(30, 80)], "x int, y int")
    f = N.register_to_reference(p, 1, "v", None, mask).toPandas()
    inside = f.gx.between(40, 89) & f.gy.between(30, 79)
    assert (f.loc[~inside, ["dx", "dy"]] == 0).all().all() and f.loc[inside, "dx"].abs().max() > 0 and len(f) == 120 * 140


def test_tiles_at_high_resolution(spark):
    base = picture(200, 220)
    p = stack_pixels(spark, [base, I.warp(base, matrix(1, 0, 2, 1), base.shape, fill=float(base.mean()))])
    pairs = spark.createDataFrame([(1, 0)], "image1 int, image2 int")
    few = spark.createDataFrame([(1, 0, k, k, 10.0 * k, 5.0, 10.0 * k + 9, 5.0) for k in range(4)], "image1 int, image2 int, i int, j int, x1 double, y1 double, x2 double, y2 double")
    new, s = N.micro_register(p, pairs, few, "v", side=100, n=200)
    r = s.first()
    assert r.taken and r.n_new > r.n_old and abs(r.d_new - 5**0.5) < 0.6
    f = M.fit_similarity(new).first()
    assert abs(f.tx - 2) < 0.5 and abs(f.ty - 1) < 0.5
    many = few.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5000)))).select(*few.columns)
    kept, s = N.micro_register(p, pairs, many, "v", side=100, n=50)
    assert not s.first().taken and kept.count() == 20_000


def test_tiles_of_regions(spark):
    b = spark.createDataFrame([(1, 5, 6, 450, 90), (2, 0, 0, 201, 200)], "slide int, x int, y int, w int, h int")
    got = sorted((r.slide, r.x, r.y, r.w, r.h) for r in N.roi_tiles(b, 200).collect())
    assert got == [(1, 5, 6, 200, 90), (1, 205, 6, 200, 90), (1, 405, 6, 50, 90), (2, 0, 0, 200, 200)]


def test_detection_by_tiles(spark):
    img = picture(100, 130)
    p = stack_pixels(spark, [img])
    whole = {(r.x, r.y): r.response for r in G.detect(p, "v", 80, tile=4096).collect()}
    parts = {(r.x, r.y): r.response for r in G.detect(p, "v", 80, tile=40).collect()}
    assert len(set(whole) & set(parts)) >= 78
    masked = G.detect(p, "v", 80, mask=p.where("x < 50").select("image", "x", "y")).collect()
    assert masked and all(r.x < 50 for r in masked)


def test_corners_on_circles_and_bits(spark):
    img = np.zeros((60, 60))
    img[20:40, 15:45] = 100
    xy, r = I.fast_corners(img, 4)
    assert {(round(x / 29.5), round(y / 29.5)) for x, y in xy} <= {(0, 1), (1, 1), (2, 1), (1, 0), (1, 2), (0, 0), (2, 2)} and len(xy) == 4 and (np.diff(r) <= 0).all()
    assert all(min(abs(x - a) + abs(y - b) for a in (15, 44) for b in (20, 39)) <= 2 for x, y in xy) and not len(I.fast_corners(np.zeros((5, 5)))[0])
    base = picture(100, 110, 6)
    p = stack_pixels(spark, [base, I.warp(base, matrix(1, 0, 3, 2), base.shape, fill=float(base.mean()))])
    kp = G.detect(p, "v", 150, corners="fast", descriptor="binary")
    m = M.with_points(M.match_pairs(kp, M.neighbour_pairs(kp), "hamming", max_distance=0.2), kp)
    shift = m.selectExpr("percentile(x1 - x2, 0.5) dx", "percentile(y1 - y2, 0.5) dy").first()
    assert m.count() > 20 and (round(shift.dx), round(shift.dy)) == (3, 2)


@pytest.fixture(scope="module")
def planted_stack(spark):
    """Five pictures, each turned, shifted and bent a little more than the one before."""
    base = picture(120, 140, 3)
    images = [bent(I.warp(base, O.rigid(np.array([0.03 * k, 2.0 * k, -1.5 * k]), base.shape, False), base.shape, fill=float(base.mean())), 40 + k) for k in range(-2, 3)]
    return stack_pixels(spark, images).persist()


def options(**more):
    return {"size": (140.0, 120.0), "features": 150, "threshold": 4.0, **more}


def test_a_whole_stack(spark, planted_stack, tmp_path):
    r = Registrar(pixels=planted_stack, non_rigid="flow", **options()).register()
    e = r.mean_errors().first()
    assert e.mean_rigid_d < 0.7 * e.mean_original_d and e.mean_non_rigid_d < 0.7 * e.mean_rigid_d
    t = r.tables
    assert {x.image2 for x in t["schedule"].where("step = 0").collect()} == {2} and t["schedule"].count() == 4
    assert np.allclose(t["transforms"].where("slide = 2").first().m, np.eye(3).ravel())
    pts = spark.createDataFrame([(0, 60.0, 50.0)], "slide int, x double, y double")
    back = r.warp_xy_from_to(pts, F.lit(0)).first()
    assert abs(back.wx - 60) < 1 and abs(back.wy - 50) < 1
    rigid, whole = r.warp_xy(pts, non_rigid=False).first(), r.warp_xy(pts).first()
    assert (rigid.wx, rigid.wy) != (whole.wx, whole.wy)
    r.save(str(tmp_path / "s"))
    again = Registrar.load(spark, str(tmp_path / "s"), size=(140.0, 120.0))
    assert again.warp_xy(pts).first() == whole
    from tilewright.operators import resample as RS

    tiles = RS.pack(planted_stack, ["v"], "float64")
    out = r.warp_tiles(tiles, 1, "float64", "bilinear", crop=(10, 10, 60, 50))
    assert {(x.w, x.h) for x in out.collect()} == {(60, 50)} and out.count() == 5
    channels = spark.createDataFrame([(k, k, 0, f"c{k}") for k in range(5)], "slide int, stack_idx int, pos int, name string")
    merged = r.merge_tiles(tiles, channels, "float64").first()
    assert merged.bands == 5
    one = r.slide(0)
    assert one.warp_xy(pts.select("x", "y")).first().wx == pytest.approx(whole.wx) and one.fixed == 1 and r.slide(2).fixed is None and len(one.m) == 9
    assert one.warp_xy_from_to(pts.select("x", "y"), r.slide(0)).first().wx == pytest.approx(back.wx)
    assert r.slide(2).warp_tiles(tiles).first().data == tiles.where("slide = 2").first().data and one.warp_tiles(tiles).count() == 1
    from tilewright.sources import images as SI

    saved = r.warp_and_save(RS.pack(planted_stack, ["v"], "uint8"), str(tmp_path / "out"), levels=2, side=64).collect()
    assert len(saved) == 5 and {x.level for x in SI.read_images(spark, str(tmp_path / "out")).select("level").collect()} == {0, 1}
    (x,) = r.merge_and_save(RS.pack(planted_stack, ["v"], "uint8"), channels, str(tmp_path / "all"), levels=1, side=64).collect()
    seen = SI.probe(spark.read.format("binaryFile").load(x.path).select("path", "content")).first()
    assert (seen.bands, seen.w, seen.h, seen.is_ome) == (5, 140, 120, True)


def test_order_reference_and_refinement(spark, planted_stack):
    one, two = picture(120, 140, 3), picture(120, 140, 4)
    places = {k: I.warp((1 - k / 6) * one + k / 6 * two, O.rigid(np.array([0.0, 1.5 * k, -k]), one.shape, False), one.shape, fill=128.0) for k in range(5)}
    turn = {0: 3, 1: 0, 2: 4, 3: 1, 4: 2}
    mixed = stack_pixels(spark, [places[next(k for k in turn if turn[k] == n)] for n in range(5)])
    r = Registrar(pixels=mixed, ordered=False, settle=1, micro=True, neighbours=True, **options()).register()
    order = [x.image for x in r.tables["order"].orderBy("place").collect()]
    want = [turn[k] for k in range(5)]
    assert order in (want, want[::-1])
    e = r.mean_errors().first()
    assert e.mean_rigid_d < 0.5 * e.mean_original_d and r.tables["micro"].count() == 4
    named = Registrar(pixels=planted_stack, reference=0, optimiser="mse", reflections=True, **options()).register()
    assert np.allclose(named.tables["transforms"].where("slide = 0").first().m, np.eye(3).ravel()) and named.tables["optimised"].count() == 4
    assert named.mean_errors().first().mean_rigid_d < 0.8 * named.mean_errors().first().mean_original_d
    own = spark.createDataFrame([(1, np.eye(3).ravel().tolist())], "slide int, m array<double>")
    user = Registrar(pixels=planted_stack, user_transforms=own, **options()).register()
    assert np.allclose(user.tables["transforms"].where("slide = 1").first().m, np.eye(3).ravel())


@pytest.fixture(scope="module")
def plain_pair(planted_stack):
    return Registrar(pixels=planted_stack.where("image < 2"), non_rigid="flow", **options()).register().tables


@pytest.mark.parametrize("kind", ["processor", "detector", "matcher", "non_rigid"])
def test_every_kind_of_plug_in_changes_the_result(spark, planted_stack, plain_pair, kind):
    seen = []
    plain = {
        "processor": lambda pixels, value: pixels.select("image", "x", "y", (255 - F.col(value)).alias("v")),
        "detector": lambda pixels, value, n: G.detect(pixels, value, 20),
        "matcher": lambda keypoints, pairs: M.match_pairs(keypoints, pairs, "manhattan").where("i % 2 = 0"),
        "non_rigid": lambda pixels: pixels.select("image", "x", "y", F.lit(1.5).alias("dx"), F.lit(0.0).alias("dy")),
    }[kind]
    register_function(kind, "mine", lambda *a: seen.append(kind) or plain(*a))
    try:
        name = {"processor": "processed", "detector": "keypoints", "matcher": "all_matches", "non_rigid": "back"}[kind]
        own = Registrar(pixels=planted_stack.where("image < 2"), **{kind: "mine"}, **options()).register().tables[name]
        assert seen and (own.count() != plain_pair[name].count() or own.exceptAll(plain_pair[name]).count() > 0)
    finally:
        del REGISTRY[kind]["mine"]


def test_errors_of_the_whole(spark):
    m, ms = planted(spark, 50, 0, 0.0)
    t = spark.createDataFrame([(0, np.eye(3).ravel().tolist()), (1, ms[1, 0].ravel().tolist()), (2, (ms[2, 1] @ ms[1, 0]).ravel().tolist())], "image int, m array<double>")
    forward = spark.createDataFrame([(k, x, y, 1.0 * k, 0.0) for k in range(3) for x in range(-8, 8) for y in range(-8, 8)], "slide int, gx int, gy int, dx double, dy double")
    e = {r.image1: r for r in N.stack_errors(m, t, forward, 100.0, 2.0, 100.0).collect()}
    assert all(e[k].rigid_d < 1e-6 and abs(e[k].non_rigid_d - 2.0) < 1e-6 and e[k].original_rtre == pytest.approx(e[k].original_d / 200) for k in (1, 2))
    assert N.mean_errors(N.stack_errors(m, t)).first().mean_rigid_d < 1e-6


def test_noise_and_levels(spark):
    rng = np.random.default_rng(0)
    p = stack_pixels(spark, [np.zeros((80, 80)) + rng.normal(0, 5, (80, 80)), rng.normal(0, 1, (80, 80))])
    s = {r.image: r.sigma for r in N.noise_of(p, "v").collect()}
    assert abs(s[0] - 5) < 0.5 and abs(s[1] - 1) < 0.1
    box = spark.createDataFrame([(1, 2, 3)], "slide int, x int, y int")
    assert T.uncropped(spark.createDataFrame([(1, 1.0, 1.0)], "slide int, x double, y double"), box).first()[1:] == (3.0, 4.0)
    assert A is not None


def joins(df):
    """The kinds of a plan's joins."""
    return [line.split("[")[0].strip(" +-:*()0123456789") for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_fields_of_many_slides_are_not_broadcast(spark, sf_dir):
    """Spark's estimate of a field is that of its slides before they are exploded, so it would send all values to the driver."""
    for query, n in ((q_warp.warp_points_non_rigid, 1), (q_register.warp_points_full, 1), (q_register.unwarp_points_full, 1), (q_register.warp_points_between_fields, 2)):
        assert sum(k.startswith("SortMergeJoin") for k in joins(query(spark, sf_dir))) >= n, query.__name__


def test_matrices_of_all_slides_are_not_broadcast(spark, sf_dir):
    for query in (q_warp.warped_canvas, q_warp.warped_area):
        kinds = joins(query(spark, sf_dir, transforms=V.all_transforms))
        assert kinds[0].startswith("SortMergeJoin") and len(kinds) == 2, kinds


@pytest.mark.parametrize("how", [{}, {"cross_check": False, "max_ratio": 0.95}, {"cross_check": False, "max_distance": 1.3}])
def test_matches_are_the_same_in_blocks(spark, how):
    """Blocks of keypoints, with equal descriptors in several of them, against images that are a block each."""
    rng = np.random.default_rng(3)
    rows = [(int(k), int(n), [float(x) for x in v]) for k in range(3) for n, v in enumerate(rng.integers(0, 4, (60 + 9 * k, 5)) + 0.1 * (rng.random((60 + 9 * k, 1)) < 0.5))]
    kp = spark.createDataFrame(rows, "image int, kp int, descr array<double>")
    one, some = (M.match_pairs(kp, M.neighbour_pairs(kp), block=b, **how).collect() for b in (1000, 13))
    assert len(one) > 10 and sorted(map(tuple, one)) == sorted(map(tuple, some))
    assert M._blocks(kp, M.neighbour_pairs(kp), 13).groupBy("image1", "image2", "b1", "b2", "side").count().agg(F.max("count")).first()[0] < 40


@pytest.mark.parametrize(("m", "n", "sharpness", "dustbin"), [(50, 60, 5.0, 0.0), (33, 20, 20.0, 0.2)])
def test_assignment_by_blocks(m, n, sharpness, dustbin):
    """Weights from blocks of similarities, kept or not, against the whole matrix."""
    rng = np.random.default_rng(0)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(m, 16)), rng.normal(size=(n, 16))))
    z = np.exp(K.sinkhorn(sharpness * a @ b.T, sharpness * dustbin, 100))[:-1, :-1]
    for held in (1 << 24, 8 * n * 7):
        best, score, back, reverse = K.assigned(a, b, sharpness, dustbin, 100, held)
        assert (best == z.argmax(axis=1)).all() and (back == z.argmax(axis=0)).all()
        assert np.allclose(score, z.max(axis=1), rtol=1e-12) and np.allclose(reverse, z.max(axis=0), rtol=1e-12)


def test_rematch_decision_of_means_that_differ_by_rounding(spark):
    """The same distances, added in another order, and one that is nearer indeed."""
    rows = [(0, 1, 0.1), (0, 1, 0.2), (0, 1, 0.3), (1, 2, 0.5), (1, 2, 0.5)]
    old = spark.createDataFrame(rows, "image1 int, image2 int, r double").coalesce(1)
    new = spark.createDataFrame([*rows[2::-1], (1, 2, 0.5), (1, 2, 0.4)], "image1 int, image2 int, r double").coalesce(1)
    assert (0.3 + 0.2) + 0.1 < (0.1 + 0.2) + 0.3
    assert {r.image1: r.decision for r in E.rematch_decision(old, new).collect()} == {0: "keep", 1: "merge"}


def test_composed_fields_are_not_broadcast(spark, sf_dir):
    assert joins(q_register.fields_composed(spark, sf_dir))[0].startswith("SortMergeJoin")

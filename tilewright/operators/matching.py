"""Descriptor matching between images: nearest neighbours, cross checks and filters, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.kernels.descriptors import two_nearest
from tilewright.kernels.points import assigned


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two descriptors of equal length."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    gap = F.zip_with(a, b, lambda p, q: p - q)
    if metric == "euclidean":
        return F.sqrt(total(F.transform(gap, lambda x: x * x)))
    if metric == "manhattan":
        return total(F.transform(gap, F.abs))
    if metric == "chebyshev":
        return F.aggregate(gap, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    if metric == "hamming":
        return total(F.zip_with(a, b, lambda p, q: F.when(p != q, 1.0).otherwise(0.0))) / F.size(a)
    if metric == "cosine":
        norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
        return 1 - total(F.zip_with(a, b, lambda p, q: p * q)) / (norm(a) * norm(b))
    raise ValueError(f"unknown metric {metric}")


def pair_distances(keypoints: DataFrame, pairs: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(image1, image2, i, j, d): all descriptors of one image against all of the other, for the listed pairs.

    The join is by image, so work is dealt out by pair; the list of pairs grows with the stack, not its square,
    when only neighbours in the stack are matched.
    """
    left = keypoints.select(F.col("image").alias("image1"), F.col("kp").alias("i"), F.col("descr").alias("descr1"))
    right = keypoints.select(F.col("image").alias("image2"), F.col("kp").alias("j"), F.col("descr").alias("descr2"))
    return left.join(pairs, "image1").join(right, "image2").select("image1", "image2", "i", "j", distance(F.col("descr1"), F.col("descr2"), metric).alias("d"))


def neighbour_pairs(keypoints: DataFrame) -> DataFrame:
    """(image1, image2) of images next to each other in the stack."""
    images = keypoints.select(F.col("image").alias("image1")).distinct()
    return images.select("image1", (F.col("image1") + 1).alias("image2")).join(images.select(F.col("image1").alias("image2")), "image2", "left_semi").select("image1", "image2")


def all_pairs(keypoints: DataFrame) -> DataFrame:
    """(image1, image2) of all images of a stack, each pair once, for stacks that are to be ordered: each image meets
    the sorted list of the stack's images, and takes those behind it."""
    images = keypoints.select(F.col("image").alias("image1")).distinct()
    stack = images.agg(F.sort_array(F.collect_list("image1")).alias("all"))
    return images.crossJoin(F.broadcast(stack)).select("image1", F.explode(F.filter("all", lambda x: x > F.col("image1"))).alias("image2"))


#: Keypoints of an image that meet those of another one in one task, on either side.
BLOCK = 8192


def _blocks(keypoints: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """(image1, image2, b1, b2, side, kp, descr): the keypoints of both images of each pair, dealt by hash into blocks of about
    ``block``, of which each of the one image meets each of the other."""
    n = keypoints.groupBy("image").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    p = pairs
    for k in "12":
        p = p.join(n.select(F.col("image").alias(f"image{k}"), F.col("n").alias(f"n{k}")), f"image{k}")
    p = p.select("image1", "image2", "n1", "n2")
    sides = []
    for k, o in ("12", "21"):
        own = keypoints.select(F.col("image").alias(f"image{k}"), F.col("kp"), F.col("descr")).join(p, f"image{k}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"n{o}") - 1)).alias(f"b{o}")
        own = own.select("image1", "image2", F.pmod(F.xxhash64("kp"), F.col(f"n{k}")).cast("int").alias(f"b{k}"), every, F.lit(int(k) - 1).alias("side"), "kp", "descr")
        sides.append(own.select("image1", "image2", "b1", "b2", "side", "kp", "descr"))
    return sides[0].unionByName(sides[1])


def match_pairs(keypoints: DataFrame, pairs: DataFrame, metric: str = "euclidean", cross_check: bool = True, max_distance: float | None = None, max_ratio: float | None = None, block: int = BLOCK) -> DataFrame:
    """(image1, image2, i, j, d): the nearest descriptor of each, ties to the lower index, see ``nearest``.

    A task holds a block of the keypoints of either image, ``block`` of each or so, however many the images have, and never
    makes a row for each two descriptors: it tells of each keypoint the nearest in the other block, and the second nearest
    distance; aggregates find the nearest of all blocks.
    """

    def run(t: pa.Table) -> pa.Table:
        side, kp = t.column("side").to_numpy(), t.column("kp").to_numpy()
        lists = t.column("descr").combine_chunks()
        one, two = (np.flatnonzero(side == k) for k in (0, 1))
        one, two = one[np.argsort(kp[one], kind="stable")], two[np.argsort(kp[two], kind="stable")]
        found = []
        if len(one) and len(two):
            whole = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            a, b = whole[one].astype(float), whole[two].astype(float)
            for k, (x, y, own, other) in enumerate([(a, b, one, two), (b, a, two, one)][: 1 + cross_check]):
                best, first, second = two_nearest(x, y, metric)
                some = np.flatnonzero(np.isfinite(first))
                found.append((np.full(len(some), k), kp[own[some]], first[some], kp[other[best[some]]], second[some]))
        k, p, d, q, second = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), kp[:0], np.zeros(0), kp[:0], np.zeros(0))
        key = {c: pa.array([t.column(c)[0].as_py()] * len(k), t.schema.field(c).type) for c in ("image1", "image2")}
        kind = t.schema.field("kp").type
        return pa.table({**key, "side": pa.array(k, pa.int32()), "p": pa.array(p, kind), "d": pa.array(d), "q": pa.array(q, kind), "second": pa.array(second)})

    image, kp = (keypoints.schema[c].dataType.simpleString() for c in ("image", "kp"))
    near = _blocks(keypoints, pairs, block).groupBy("image1", "image2", "b1", "b2").applyInArrow(run, f"image1 {image}, image2 {image}, side int, p {kp}, d double, q {kp}, second double")
    # The second nearest of all blocks is the second of the nearest one's block, or another block's nearest.
    m = F.struct("d", "q", "second")
    near = near.groupBy("image1", "image2", "side", "p").agg(F.min(m).alias("m"), F.sort_array(F.collect_list("d")).alias("ds"))
    second = F.least("m.second", F.coalesce(F.get("ds", F.lit(1)), F.lit(float("inf"))))
    turned = lambda a, b: F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b))
    best = near.select("image1", "image2", "side", turned("p", "m.q").alias("i"), turned("m.q", "p").alias("j"), F.col("m.d").alias("d"), second.alias("second"))
    if cross_check:  # each side has a row a keypoint, so two rows of a pair are both sides'
        own = lambda c: F.min(F.when(F.col("side") == 0, F.col(c))).alias(c)
        best = best.groupBy("image1", "image2", "i", "j").agg(F.count(F.lit(1)).alias("n"), own("d"), own("second")).where("n = 2")
    if max_distance is not None:
        best = best.where(F.col("d") < max_distance)
    if max_ratio is not None:
        best = best.where((F.col("second") == float("inf")) | (F.col("d") < max_ratio * F.col("second")))
    return best.select("image1", "image2", "i", "j", "d")


def assigned_pairs(keypoints: DataFrame, pairs: DataFrame, dustbin: float = 0.2, sharpness: float = 20.0, least: float = 0.2, rounds: int = 100) -> DataFrame:
    """(image1, image2, i, j, score): descriptors of two images assigned to each other, each at most once.

    Cosine similarities, times ``sharpness``, are normalised in turn by rows and by columns, with a bin of similarity ``dustbin`` for those
    without a partner; pairs that are each other's best and score ``least`` or more are kept. A pair of images is a task, which
    holds its descriptors and a block of their similarities.
    """
    left, right = (keypoints.select(F.col("image").alias(f"image{k}"), "kp", "descr") for k in (1, 2))
    both = left.join(pairs, "image1").select("image1", "image2", F.lit(0).alias("side"), "kp", "descr").unionByName(right.join(pairs, "image2").select("image1", "image2", F.lit(1).alias("side"), "kp", "descr"))

    def run(t: pa.Table) -> pa.Table:
        side, kp = t.column("side").to_numpy(), t.column("kp").to_numpy()
        lists = t.column("descr").combine_chunks()
        whole = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
        one, two = (np.flatnonzero(side == k) for k in (0, 1))
        one, two = one[np.argsort(kp[one], kind="stable")], two[np.argsort(kp[two], kind="stable")]
        i = j = np.zeros(0, int)
        score = np.zeros(0)
        if len(one) and len(two):
            unit = whole / np.maximum(np.sqrt((whole * whole).sum(axis=1, keepdims=True)), 1e-12)
            best, most, back, _ = assigned(unit[one], unit[two], sharpness, dustbin, rounds)
            i = np.flatnonzero((back[best] == np.arange(len(one))) & (most >= least))
            j, score = best[i], most[i]
        key = {c: pa.array([t.column(c)[0].as_py()] * len(i), t.schema.field(c).type) for c in ("image1", "image2")}
        return pa.table({**key, "i": pa.array(kp[one][i], t.schema.field("kp").type), "j": pa.array(kp[two][j], t.schema.field("kp").type), "score": pa.array(score)})

    image, kp = (keypoints.schema[c].dataType.simpleString() for c in ("image", "kp"))
    return both.groupBy("image1", "image2").applyInArrow(run, f"image1 {image}, image2 {image}, i {kp}, j {kp}, score double")


def nearest(distances: DataFrame, cross_check: bool = True, max_distance: float | None = None, max_ratio: float | None = None) -> DataFrame:
    """(image1, image2, i, j, d): the nearest descriptor of each, ties to the lower index.

    cross_check keeps pairs that are each other's nearest. max_distance is exclusive. max_ratio keeps
    matches of which the distance is below that part of the second nearest one's.
    """
    pair = ["image1", "image2"]
    best = distances.groupBy(*pair, "i").agg(F.min(F.struct("d", "j")).alias("m"))
    if max_ratio is not None:
        # The second nearest is the least of the others.
        others = distances.join(best.select(*pair, "i", F.col("m.j").alias("j")), [*pair, "i", "j"], "left_anti").groupBy(*pair, "i").agg(F.min("d").alias("second"))
        best = best.join(others, [*pair, "i"], "left").where(F.col("second").isNull() | (F.col("m.d") < max_ratio * F.col("second"))).drop("second")
    best = best.select(*pair, "i", F.col("m.j").alias("j"), F.col("m.d").alias("d"))
    if cross_check:
        back = distances.groupBy(*pair, "j").agg(F.min(F.struct("d", "i")).alias("m")).select(*pair, "j", F.col("m.i").alias("i"))
        best = best.join(back, [*pair, "i", "j"], "left_semi")
    return best if max_distance is None else best.where(F.col("d") < max_distance)


def with_points(matches: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Matches with the coordinates of both keypoints: x1, y1, x2, y2."""
    one = keypoints.select(F.col("image").alias("image1"), F.col("kp").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    two = keypoints.select(F.col("image").alias("image2"), F.col("kp").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return matches.join(one, ["image1", "i"]).join(two, ["image2", "j"])


def fit_similarity(matches: DataFrame) -> DataFrame:
    """(image1, image2, n, a, b, tx, ty): least squares similarity from points 1 to points 2, in one pass of covariances.

    x2 = a x1 - b y1 + tx, y2 = b x1 + a y1 + ty. a and b are null where all points 1 are one.
    """
    f = matches.groupBy("image1", "image2").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")],
        (F.covar_pop("x1", "x2") + F.covar_pop("y1", "y2")).alias("dot"),
        (F.covar_pop("x1", "y2") - F.covar_pop("y1", "x2")).alias("cross"),
        (F.var_pop("x1") + F.var_pop("y1")).alias("size"),
    )
    f = f.withColumns({"a": F.try_divide("dot", "size"), "b": F.try_divide("cross", "size")})
    return f.select("image1", "image2", "n", "a", "b", (F.col("m_x2") - F.col("a") * F.col("m_x1") + F.col("b") * F.col("m_y1")).alias("tx"), (F.col("m_y2") - F.col("b") * F.col("m_x1") - F.col("a") * F.col("m_y1")).alias("ty"))


def residuals(matches: DataFrame, fits: DataFrame) -> DataFrame:
    """Matches with r, the distance of the transformed point 1 from point 2."""
    m = matches.join(fits.select("image1", "image2", "a", "b", "tx", "ty"), ["image1", "image2"])
    dx = F.col("a") * F.col("x1") - F.col("b") * F.col("y1") + F.col("tx") - F.col("x2")
    dy = F.col("b") * F.col("x1") + F.col("a") * F.col("y1") + F.col("ty") - F.col("y2")
    return m.withColumn("r", F.sqrt(dx * dx + dy * dy))


def tukey_filter(matches: DataFrame, value: str = "r", width: float = 3.0) -> DataFrame:
    """Matches strictly within ``width`` interquartile ranges of the quartiles of their image pair."""
    q = matches.groupBy("image1", "image2").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    reach = width * (high - low)
    return matches.join(q, ["image1", "image2"]).where((F.col(value) > low - reach) & (F.col(value) < high + reach)).drop("q")


def top_features(keypoints: DataFrame, n: int = 7500) -> DataFrame:
    """The n keypoints of each image with the largest response, ties to the lower index."""
    w = Window.partitionBy("image").orderBy(F.desc("response"), "kp")
    return keypoints.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def metric_matrix(summary: DataFrame) -> DataFrame:
    """(a, b, similarity, distance) of all image pairs both ways, with the diagonal, scaled by the largest value."""
    both = summary.select(F.col("image1").alias("a"), F.col("image2").alias("b"), "value").union(summary.select(F.col("image2").alias("a"), F.col("image1").alias("b"), "value"))
    most = both.agg(F.max("value").alias("most"))
    scaled = both.crossJoin(F.broadcast(most)).select("a", "b", F.try_divide(F.col("value").cast("double"), F.col("most").cast("double")).alias("similarity"))
    images = both.select(F.col("a")).distinct()
    diagonal = images.select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity"))
    return scaled.union(diagonal).withColumn("distance", 1 - F.col("similarity"))


def neighbours_only(matches: DataFrame, order: DataFrame) -> DataFrame:
    """Matches of images that are next to each other in ``order`` (image, place)."""
    at = lambda k: order.select(F.col("image").alias(f"image{k}"), F.col("place").alias(f"__p{k}"))
    return matches.join(at(1), "image1").join(at(2), "image2").where(F.abs(F.col("__p1") - F.col("__p2")) == 1).drop("__p1", "__p2")


def both_ways(matches: DataFrame) -> DataFrame:
    """Matches from the first image to the second, and from the second to the first."""
    turn = {"image1": "image2", "image2": "image1", "i": "j", "j": "i", "x1": "x2", "x2": "x1", "y1": "y2", "y2": "y1"}
    return matches.unionByName(matches.select(*[F.col(turn.get(c, c)).alias(c) for c in matches.columns]))


def in_mask(matches: DataFrame, masks: DataFrame) -> DataFrame:
    """Matches of which both points lie within their images' masks (image, x, y)."""
    at = lambda x, y: (F.floor(F.col(x) + 0.5).cast("int"), F.floor(F.col(y) + 0.5).cast("int"))
    out = matches
    for k in (1, 2):
        x, y = at(f"x{k}", f"y{k}")
        own = masks.select(F.col("image").alias(f"image{k}"), F.col("x").cast("int").alias("__x"), F.col("y").cast("int").alias("__y"))
        out = out.withColumns({"__x": x, "__y": y}).join(own, [f"image{k}", "__x", "__y"], "left_semi").drop("__x", "__y")
    return out.select(*matches.columns)


def cell_neighbours(matches: DataFrame, window: float) -> DataFrame:
    """Matches of an image with one of its neighbours that lie in a cell, ``window`` pixels a side, in which the other
    neighbour has matches as well. ``matches`` are both ways, see ``both_ways``."""
    cells = matches.withColumns({"__cx": F.floor(F.col("x1") / window), "__cy": F.floor(F.col("y1") / window)})
    hit = cells.groupBy("image1", "__cx", "__cy").agg(F.count_distinct("image2").alias("__k")).where("__k > 1").drop("__k")
    return cells.join(hit, ["image1", "__cx", "__cy"], "left_semi").select(*matches.columns)


def better_subset(matches: DataFrame, subset: DataFrame, least: int = 3) -> DataFrame:
    """Per image pair ``subset``, if it has ``least`` matches or more and its fit leaves no larger median distance than that of all, or else all."""
    pair = ["image1", "image2"]
    score = lambda m, n: residuals(m, fit_similarity(m)).groupBy(*pair).agg(F.count(F.lit(1)).alias(f"{n}_n"), F.percentile("r", 0.5).alias(f"{n}_r"))
    s = score(matches, "all").join(score(subset, "sub"), pair, "left")
    good = s.where((F.col("sub_n") >= least) & (F.col("sub_r") <= F.col("all_r"))).select(*pair)
    return subset.join(good, pair, "left_semi").unionByName(matches.join(good, pair, "left_anti"))

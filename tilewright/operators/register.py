"""Registration by intensities: affine refinement, non-rigid fields along a stack, and refinement by tiles at high resolution.

Images are at working size, some thousand pixels a side at most, where a task holds a pair; what may be larger goes by tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.kernels import optimise as O
from tilewright.operators import estimate as E
from tilewright.operators import fields as D
from tilewright.operators import grouped as G
from tilewright.operators import matching as M
from tilewright.operators import resample as R
from tilewright.session import checkpointed

PAIR = ["image1", "image2"]


def optimise_pairs(pixels: DataFrame, value: str, pairs: DataFrame, cost: str = "nmi", levels: int = 3, with_scale: bool = False, seed: int = 0) -> DataFrame:
    """(image1, image2, m, before, after): per pair the matrix from image 2's pixels to image 1's under which they are most alike, by a
    cost of ``kernels.optimise.COSTS``, starting from the pair's ``m``. It is ``m`` itself, with equal costs, where nothing is better."""
    p = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v"))
    both = p.join(pairs.select(F.col("image1").alias("image"), *PAIR, "m"), "image").unionByName(p.join(pairs.select(F.col("image2").alias("image"), *PAIR, "m"), "image"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        one, two = t["image1"].iloc[0], t["image2"].iloc[0]
        moving, fixed = G.dense(t[t["image"] == one], "v"), G.dense(t[t["image"] == two], "v")
        m, before, after = O.align(fixed, moving, np.array(t["m"].iloc[0], float).reshape(3, 3), cost, levels, with_scale, seed=seed)
        return pd.DataFrame({"image1": [one], "image2": [two], "m": [m.ravel().tolist()], "before": before, "after": after})

    kind = pixels.schema["image"].dataType.simpleString()
    return both.groupBy(*PAIR).applyInPandas(run, f"image1 {kind}, image2 {kind}, m array<double>, before double, after double")


def refine(transforms: DataFrame, optimised: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(image1, image2, m): the optimised matrices where the cost is no larger and, if there are matches, neither is the median
    distance that they leave; otherwise those of ``transforms`` (image1, image2, m)."""
    j = transforms.join(optimised.select(*PAIR, F.col("m").alias("__new"), (F.col("after") <= F.col("before")).alias("__ok")), PAIR, "left")
    if matches is not None:
        left = lambda m, n: (
            matches.join(m, PAIR).withColumn("__p", A.apply_xy(F.col("m"), F.col("x2"), F.col("y2"))).groupBy(*PAIR)
            .agg(F.percentile(F.sqrt((F.col("__p.x") - F.col("x1")) ** 2 + (F.col("__p.y") - F.col("y1")) ** 2), 0.5).alias(n))
        )
        j = j.join(left(transforms.select(*PAIR, "m"), "__old_d"), PAIR, "left").join(left(optimised.select(*PAIR, "m"), "__new_d"), PAIR, "left")
        j = j.withColumn("__ok", F.col("__ok") & F.coalesce(F.col("__new_d") <= F.col("__old_d"), F.lit(True)))
    return j.select(*PAIR, F.when(F.coalesce("__ok", F.lit(False)), F.col("__new")).otherwise(F.col("m")).alias("m"))


def image_entropy(pixels: DataFrame, a: str, b: str, bins: int = 32) -> DataFrame:
    """(image, mi): mutual information of two bands of an image, of bins between their extremes, from grouping sets."""
    ends = pixels.groupBy("image").agg(*[f(c).cast("double").alias(f"{n}_{k}") for k, c in (("a", a), ("b", b)) for n, f in (("lo", F.min), ("hi", F.max))])
    cut = lambda c, k: F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{k}"), F.col(f"hi_{k}") - F.col(f"lo_{k}")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int").alias(k)
    t = pixels.select("image", a, b).join(ends, "image").select("image", cut(a, "a"), cut(b, "b"))
    sets = t.groupingSets([["image", "a", "b"], ["image", "a"], ["image", "b"], ["image"]], "image", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # The entropy of a histogram is ln N less the mean of ln n.
    sums = sets.groupBy("image").agg(*[F.sum(F.when(F.col("g") == g, F.col("n") * F.log("n"))).alias(c) for g, c in ((0, "ab"), (1, "a"), (2, "b"))], F.max(F.when(F.col("g") == 3, F.col("n"))).alias("n"))
    return sums.select("image", (F.log("n") - (F.col("a") + F.col("b") - F.col("ab")) / F.col("n")).alias("mi"))


def pairwise_flow(pixels: DataFrame, pairs: DataFrame, value: str, calc: Callable[[DataFrame], DataFrame] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(slide, gx, gy, dx, dy): per pair (moving image1, fixed image2) the backward field on the fixed image's pixels that takes the
    moving image to it. ``calc`` makes (image, x, y, dx, dy) of pixels (image, x, y, fixed, moving). Outside of ``mask`` (x, y), and
    of its bounding box from the start, fields are 0."""
    p = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v"))
    moving = p.join(pairs.select(F.col("image1").alias("image"), "image2"), "image").select(F.col("image").alias("image1"), "image2", "x", "y", F.col("v").alias("moving"))
    fixed = p.join(pairs.select(F.col("image2").alias("image"), "image1"), "image").select("image1", F.col("image").alias("image2"), "x", "y", F.col("v").alias("fixed"))
    both = fixed.join(moving, ["image1", "image2", "x", "y"], "left").select(F.col("image1").alias("image"), "x", "y", "fixed", F.coalesce("moving", F.lit(0.0)).alias("moving"))
    if mask is not None:
        box = mask.agg(F.min("x").alias("__a"), F.max("x").alias("__b"), F.min("y").alias("__c"), F.max("y").alias("__d"))
        part = both.crossJoin(F.broadcast(box)).where("x BETWEEN __a AND __b AND y BETWEEN __c AND __d").drop("__a", "__b", "__c", "__d")
        found = (calc or (lambda t: G.flow(t, "fixed", "moving")))(part).join(mask.select(F.col("x").cast("int"), F.col("y").cast("int")), ["x", "y"], "left_semi")
        found = both.select("image", "x", "y").join(found, ["image", "x", "y"], "left").fillna(0.0, ["dx", "dy"])
    else:
        found = (calc or (lambda t: G.flow(t, "fixed", "moving")))(both)
    return found.select(F.col("image").alias("slide"), F.col("x").alias("gx"), F.col("y").alias("gy"), "dx", "dy")


def warp_by_field(pixels: DataFrame, field: DataFrame, value: str) -> DataFrame:
    """(image, x, y, v): images under backward fields on their own pixels, bilinear; images without a field stay."""
    p = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v"))
    frame = p.groupBy(F.col("image").alias("slide")).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).withColumn("m", A.identity())
    t = R.warp_images(R.pack(p, ["v"]), frame, field, 1, "float64", "bilinear")
    return R.unpack(t, ["v"])


def register_serial(pixels: DataFrame, steps: DataFrame, value: str, calc: Callable[[DataFrame], DataFrame] | None = None, compose: bool = True, mask: DataFrame | None = None, slides: DataFrame | None = None) -> DataFrame:
    """(slide, gx, gy, dx, dy): backward fields that take each image of a registered stack to the one before it on the way to the
    reference, as that one is after its own field. ``steps`` has moving, fixed and step: all images of one step, one on either side of
    the reference, are registered at once, and steps one after the other.

    With ``compose`` an image first moves by the field of its fixed one, which it then keeps and adds to. With ``slides``
    (slide, m, src_w, src_h), what pulls pixels from outside of an image into it is taken out of its field.
    """
    p = checkpointed(pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v")))
    moved, done = p, None
    for k in range((steps.agg(F.max("step")).first()[0] if steps.limit(1).count() else -1) + 1):
        now = steps.where(F.col("step") == k).select(F.col("moving").alias("image1"), F.col("fixed").alias("image2"))
        images = p.join(now.select(F.col("image1").alias("image")), "image", "left_semi")
        before = None
        if compose and done is not None:
            before = checkpointed(done.join(now, F.col("slide") == F.col("image2")).select(F.col("image1").alias("slide"), "gx", "gy", "dx", "dy"))
            images = warp_by_field(images, before, "v")
        fixed = moved.join(now.select(F.col("image2").alias("image")).distinct(), "image", "left_semi")
        own = checkpointed(pairwise_flow(images.select("image", "x", "y", "v").unionByName(fixed.join(images.select("image").distinct(), "image", "left_anti").select("image", "x", "y", "v")), now, "v", calc, mask))
        field = D.compose(own, before) if before is not None else own
        if slides is not None:
            field = D.remove_invasive(field, slides)
        field = checkpointed(field)
        done = field if done is None else checkpointed(done.unionByName(field))
        after = warp_by_field(p.join(now.select(F.col("image1").alias("image")), "image", "left_semi"), field, "v").select("image", "x", "y", "v")
        moved = checkpointed(moved.join(now.select(F.col("image1").alias("image")), "image", "left_anti").unionByName(after))
    return done if done is not None else p.sparkSession.createDataFrame([], f"slide {p.schema['image'].dataType.simpleString()}, gx int, gy int, dx double, dy double")


def register_to_reference(pixels: DataFrame, reference: int | str, value: str, calc: Callable[[DataFrame], DataFrame] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(slide, gx, gy, dx, dy): backward fields that take each image straight to the reference, all at once."""
    images = pixels.select("image").distinct().where(F.col("image") != F.lit(reference))
    pairs = images.select(F.col("image").alias("image1"), F.lit(reference).cast(pixels.schema["image"].dataType).alias("image2"))
    return pairwise_flow(pixels, pairs, value, calc, mask)


def register_groupwise(pixels: DataFrame, value: str, rounds: int = 3, calc: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(slide, gx, gy, dx, dy): backward fields that take all images to their mean, which follows them, some times over."""
    p = checkpointed(pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v")))
    moved, field = p, None
    for _ in range(rounds):
        mean = moved.groupBy("x", "y").agg(F.avg("v").alias("fixed"))
        both = moved.select("image", "x", "y", F.col("v").alias("moving")).join(mean, ["x", "y"]).select("image", "x", "y", "fixed", "moving")
        step = (calc or (lambda t: G.flow(t, "fixed", "moving")))(both).select(F.col("image").alias("slide"), F.col("x").alias("gx"), F.col("y").alias("gy"), "dx", "dy")
        step = checkpointed(step)
        field = step if field is None else checkpointed(D.compose(step, field))
        moved = checkpointed(warp_by_field(p, field, "v").select("image", "x", "y", "v"))
    return field


def roi_tiles(boxes: DataFrame, side: int) -> DataFrame:
    """(slide, tx, ty, x, y, w, h): tiles of boxes (slide, x, y, w, h), row by row, of the side or of the box where it is smaller;
    a last one closes the box where the others end more than a pixel before it."""

    def starts(size: str) -> Column:
        step = F.least(F.lit(side), F.floor(F.col(size))).cast("int")
        return F.when(step > 0, F.sequence(F.lit(0), F.greatest(F.ceil(F.col(size) - 1).cast("int") - 1, F.lit(0)), step)).otherwise(F.array().cast("array<int>"))

    b = boxes.select("slide", "x", "y", "w", "h", starts("w").alias("xs"), starts("h").alias("ys"))
    b = b.select("*", F.posexplode("ys").alias("ty", "oy")).select("*", F.posexplode("xs").alias("tx", "ox"))
    return b.select("slide", "tx", "ty", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), F.least(F.lit(side), F.col("w") - F.col("ox")).alias("w"), F.least(F.lit(side), F.col("h") - F.col("oy")).alias("h"))


def micro_register(
    pixels: DataFrame, pairs: DataFrame, old: DataFrame, value: str, side: int = 512, n: int = 500, threshold: float = 7.0, least: int = 3,
    detector: Callable[[DataFrame, str, int], DataFrame] = G.detect, mask: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(matches, summary): matches of neighbouring images found tile by tile, at high resolution, where they already lie in one frame.

    ``pixels`` (image, x, y, value) are of the registered frame; ``old`` are the matches there are (image1, image2, i, j, x1, y1, x2,
    y2), in that frame. Keypoints of a tile meet those of the same tile of the other image; tiles of ``least`` matches and
    more, without outliers, are pooled, filtered robustly over the pair, and kept within ``mask`` (x, y) if there is one. A pair takes its new matches
    if they are as many as its old ones or more. The summary has image1, image2, n_old, n_new, d_old, d_new and taken.
    """
    kp = checkpointed(detector(pixels, value, n * 16))
    tile = F.concat_ws("/", F.col("image").cast("string"), F.floor(F.col("x") / side).cast("string"), F.floor(F.col("y") / side).cast("string"))
    named = kp.withColumn("tile", tile)
    grid = named.select("image", "tile").distinct().withColumn("at", F.expr("substring_index(tile, '/', -2)"))
    two = pairs.select(*PAIR).join(grid.select(F.col("image").alias("image1"), F.col("tile").alias("t1"), "at"), "image1").join(grid.select(F.col("image").alias("image2"), F.col("tile").alias("t2"), "at"), ["image2", "at"])
    two = checkpointed(two.select(*PAIR, "t1", "t2"))
    own = named.select(F.col("tile").alias("image"), "kp", "x", "y", "descr")
    found = M.with_points(M.match_pairs(own, two.select(F.col("t1").alias("image1"), F.col("t2").alias("image2"))), own)
    found = checkpointed(found)
    enough = found.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select(*PAIR)
    found = found.join(enough, PAIR, "left_semi")
    tight = M.tukey_filter(M.residuals(found, M.fit_similarity(found))).select(*found.columns)
    names = two.select(F.col("t1").alias("image1"), F.col("t2").alias("image2"), F.col("image1").alias("__1"), F.col("image2").alias("__2"))
    pooled = tight.join(names, PAIR).select(F.col("__1").alias("image1"), F.col("__2").alias("image2"), "i", "j", "x1", "y1", "x2", "y2")
    if mask is not None:
        both = mask.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
        masks = pairs.select(F.col("image1").alias("image")).union(pairs.select(F.col("image2").alias("image"))).distinct().crossJoin(F.broadcast(both))
        pooled = M.in_mask(pooled, masks)
    new = checkpointed(E.filter_matches(pooled, "ransac", threshold))
    old = old.select("image1", "image2", "i", "j", "x1", "y1", "x2", "y2")
    gap = F.percentile(F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2), 0.5)
    score = lambda m, k: m.groupBy(*PAIR).agg(F.count(F.lit(1)).alias(f"n_{k}"), gap.alias(f"d_{k}"))
    s = pairs.select(*PAIR).join(score(old, "old"), PAIR, "left").join(score(new, "new"), PAIR, "left").fillna(0, ["n_old", "n_new"])
    s = checkpointed(s.withColumn("taken", (F.col("n_new") >= F.col("n_old")) & (F.col("n_new") > 0)))
    taken = s.where("taken").select(*PAIR)
    kind = {c: old.schema[c].dataType for c in old.columns}
    fresh = new.join(taken, PAIR, "left_semi").select(*[F.col(c).cast(kind[c]).alias(c) for c in old.columns])
    return old.join(taken, PAIR, "left_anti").unionByName(fresh), s


def registered_points(matches: DataFrame, transforms: DataFrame) -> DataFrame:
    """Matches with both points in the registered frame. ``transforms`` has image and m."""
    inv = transforms.select("image", A.inverse(F.col("m")).alias("inv"))
    out = matches
    for k in (1, 2):
        out = out.join(inv.select(F.col("image").alias(f"image{k}"), F.col("inv").alias(f"__i{k}")), f"image{k}").withColumn(f"__p{k}", A.apply_xy(F.col(f"__i{k}"), F.col(f"x{k}"), F.col(f"y{k}")))
    place = {f"{c}{k}": F.col(f"__p{k}.{c}") for k in (1, 2) for c in "xy"}
    return out.select(*[place.get(c, F.col(c)).alias(c) for c in matches.columns])


def stack_errors(matches: DataFrame, transforms: DataFrame, forward: DataFrame | None = None, diagonal: float = 1.0, per_pixel: float = 1.0, cell: float = 1.0) -> DataFrame:
    """(image1, image2, n, original_d, original_rtre, rigid_d, rigid_rtre, non_rigid_d, non_rigid_rtre): medians of the distances of
    matched points as they were, under the transforms, and under the forward fields as well, times ``per_pixel``; and as parts of the diagonal."""
    from tilewright.operators import warp as W

    d = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    rigid = registered_points(matches, transforms)
    kinds = {"original": matches, "rigid": rigid}
    if forward is not None:
        moved = rigid
        for k in (1, 2):
            p = moved.select(*[c for c in moved.columns if c not in (f"x{k}", f"y{k}")], F.col(f"image{k}").alias("slide"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
            moved = W.displace(p, forward, cell).select(*[c for c in moved.columns if c not in (f"x{k}", f"y{k}")], F.col("wx").alias(f"x{k}"), F.col("wy").alias(f"y{k}"))
        kinds["non_rigid"] = moved
    out = None
    for name, m in kinds.items():
        e = m.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), (F.percentile(d, 0.5) * per_pixel).alias(f"{name}_d"), (F.percentile(d, 0.5) / diagonal).alias(f"{name}_rtre"))
        out = e if out is None else out.join(e.drop("n"), PAIR)
    return out


def mean_errors(errors: DataFrame) -> DataFrame:
    """One row: the mean of each distance, pairs weighted by their matches."""
    names = [c for c in errors.columns if c.endswith("_d")]
    return errors.agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"mean_{c}") for c in names])


def micro_level(levels: DataFrame, most: int, bands: int = 1, bytes_a_value: int = 1, limit_gb: float = 10.0) -> DataFrame:
    """(slide, level, w, h, gb, tiled): the first level of which the larger side is ``most`` at most, or the last; its size in memory, with
    two fields and two images, and whether that asks for tiles."""
    fits = F.greatest("w", "h") <= most
    pick = levels.groupBy("slide").agg(F.coalesce(F.min(F.when(fits, F.struct("level", "w", "h"))), F.max(F.struct("level", "w", "h"))).alias("l"))
    gb = F.col("w").cast("double") * F.col("h") * (2 * bands * bytes_a_value + 2 * 2 * 8) / float(1 << 30)
    return pick.select("slide", "l.*").withColumn("gb", gb).withColumn("tiled", gb > limit_gb)


def noise_of(pixels: DataFrame, value: str) -> DataFrame:
    """(image, sigma): the deviation of each image's noise, from the differences of differences of each two by two pixels."""
    sign = F.when((F.col("x") + F.col("y")) % 2 == 0, 1.0).otherwise(-1.0)
    cells = pixels.groupBy("image", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum(sign * F.col(value)).alias("d"), F.count(F.lit(1)).alias("n")).where("n = 4")
    # Half of the standard normal lies within 0.6745, and the difference of four has twice the deviation of one.
    return cells.groupBy("image").agg((F.percentile(F.abs("d"), 0.5) / 2 / 0.6744897501960817).alias("sigma"))

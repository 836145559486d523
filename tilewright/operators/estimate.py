"""Rigid estimation over stacks of images, and measures of its error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.operators import matching as M
from tilewright.operators.grouped import ransac_filter
from tilewright.session import checkpointed

PAIR = ["image1", "image2"]


def match_summary(matches: DataFrame, n_features: int) -> DataFrame:
    """Number of matches, their mean distance, its similarity and the distance that gives that similarity."""
    s = matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"))
    similarity = F.exp(-F.col("mean_d") / n_features)
    return s.select(*PAIR, "n", F.round("mean_d", 6).alias("mean_d"), F.round(similarity, 6).alias("similarity"), F.round(-F.log(similarity + F.lit(2.220446049250313e-16)) * n_features, 6).alias("distance"))


def register_pairs(keypoints: DataFrame, size: tuple[float, float]) -> DataFrame:
    """Errors of neighbouring images before and after a similarity fit on filtered mutual matches."""
    m = checkpointed(M.with_points(M.match_pairs(keypoints, M.neighbour_pairs(keypoints)), keypoints))
    kept = M.tukey_filter(M.residuals(m, M.fit_similarity(m))).drop("r", "a", "b", "tx", "ty")
    return measure(M.residuals(kept, M.fit_similarity(kept)), size)


def measure(matches: DataFrame, size: tuple[float, float]) -> DataFrame:
    """Median distances of matched points before and after, and the latter as a part of the image's diagonal."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    diagonal = (size[0] ** 2 + size[1] ** 2) ** 0.5
    return matches.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(F.sqrt(dx * dx + dy * dy), 0.5).alias("original_d"),
        F.percentile("r", 0.5).alias("rigid_d"),
        F.percentile(F.col("r") / diagonal, 0.5).alias("rigid_rtre"),
    )


def alignment_schedule(images: DataFrame) -> DataFrame:
    """(step, moving, fixed): from the reference, the middle of the stack, down and then up. Of two images the first is it."""
    n = F.count_distinct("image")
    ref = images.agg(F.when(n == 2, 0).otherwise(F.expr("count(distinct image) div 2")).cast("int").alias("r"), F.max("image").cast("int").alias("most"))
    down = ref.where("r > 0").selectExpr("r", "explode(sequence(0, r - 1)) as k").selectExpr("k as step", "r - k - 1 as moving", "r - k as fixed")
    up = ref.where("most > r").selectExpr("explode(sequence(r, most - 1)) as k").selectExpr("k as step", "k + 1 as moving", "k as fixed")
    return down.unionByName(up)


def chain(steps: DataFrame, stack: str | None = None) -> DataFrame:
    """(image, m): the product of the matrices of all steps from an image to the first, and the identity for image 0.

    ``steps`` has the matrix from image - 1 to image, of one stack or of each by a column ``stack``.
    """
    key = [stack] if stack else []
    first = steps.select(*key, F.lit(0).cast(steps.schema["image"].dataType).alias("image")).distinct()
    whole = chain_to_reference(steps.select(*key, "image", (F.col("image") - 1).cast(steps.schema["image"].dataType).alias("fixed"), "m"), stack, first)
    return whole


def chain_to_reference(steps: DataFrame, stack: str | None = None, references: DataFrame | None = None) -> DataFrame:
    """(image, m), with the stack's column if there is one: the product of the matrices along each image's path to the reference.

    ``steps`` has image, fixed (the image that it was fitted to) and m; images of ``references`` get the identity. Paths
    double in each round, so a stack of n images takes log n rounds, and stacks of any number go through them together.
    """
    key = [stack] if stack else []
    now = steps.select(*key, "image", F.col("fixed").alias("to"), "m")
    if references is None:
        ends = now.select(*key, F.col("to").alias("image")).join(now.select(*key, "image"), [*key, "image"], "left_anti").distinct()
    else:
        ends = references.select(*key, "image").join(now.select(*key, "image"), [*key, "image"], "left_anti").distinct()
    while True:
        now = checkpointed(now)
        beyond = now.select(*key, F.col("image").alias("to"), F.col("to").alias("__next"), F.col("m").alias("__m"))
        if not now.join(beyond, [*key, "to"], "left_semi").limit(1).count():
            break
        j = now.join(beyond, [*key, "to"], "left")
        now = j.select(*key, "image", F.coalesce("__next", "to").alias("to"), F.when(F.col("__m").isNull(), F.col("m")).otherwise(A.matmul(F.col("m"), F.col("__m"))).alias("m"))
    return now.select(*key, "image", "m").unionByName(ends.select(*key, "image", A.identity().alias("m")))


def filter_matches(matches: DataFrame, method: str = "ransac", threshold: float = 7.0, grid: tuple[float, float] = (64.0, 4.0), seed: int = 0) -> DataFrame:
    """Matches that a robust fit of their pair keeps ('ransac'), or the motion of their neighbours ('gms', by ``grid``: cell
    and factor), and of these the ones without outlying distances from their fit."""
    if method == "ransac":
        kept = ransac_filter(matches, threshold, seed=seed)
    elif method == "gms":
        cell, factor = grid
        c = lambda k: F.floor(F.col(k) / cell).cast("int")
        good = grid_motion(matches, cell, factor).where("accepted").select(*PAIR, "cx", "cy", "ex", "ey")
        at = matches.withColumns({"cx": c("x1"), "cy": c("y1"), "ex": c("x2"), "ey": c("y2")})
        kept = at.join(good, [*PAIR, "cx", "cy", "ex", "ey"], "left_semi").select(*matches.columns)
    else:
        raise ValueError(f"unknown filter {method}")
    kept = checkpointed(kept)
    return M.tukey_filter(M.residuals(kept, M.fit_similarity(kept))).select(*kept.columns)


def guarded(matches: DataFrame, fits: DataFrame, max_scale: float = 5.0) -> DataFrame:
    """(image1, image2, a, b, tx, ty, kept): each pair's fit, or the identity where it takes points further apart on average.
    A scale of ``max_scale`` or more, or of its inverse or less, is no fit either."""
    gap = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    nearer = M.residuals(matches, fits).groupBy(*PAIR).agg((F.avg("r") <= F.avg(gap)).alias("nearer"))
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    good = F.coalesce(F.col("nearer") & (size < max_scale) & (size > 1 / max_scale), F.lit(False))
    f = fits.join(nearer, PAIR, "left").withColumn("kept", good)
    return f.select(*PAIR, *[F.when(F.col("kept"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in (("a", 1.0), ("b", 0.0), ("tx", 0.0), ("ty", 0.0))], "kept")


def rematch(old: DataFrame, new: DataFrame, threshold: float = 7.0) -> DataFrame:
    """Matches of each pair: the new ones if there are more and they are nearer, the old ones if neither, and otherwise those of both that a
    robust fit keeps. Both have image1, image2, i, j, x1, y1, x2, y2; new indices follow the old ones."""
    columns = [*PAIR, "i", "j", "x1", "y1", "x2", "y2"]
    old, new = old.select(*columns), new.select(*columns)
    score = lambda m: M.residuals(m, M.fit_similarity(m))
    what = checkpointed(rematch_decision(score(old), score(new)).select(*PAIR, "decision"))
    pick = lambda m, d: m.join(what.where(F.col("decision") == d).select(*PAIR), PAIR, "left_semi")
    most = old.groupBy(*PAIR).agg(F.max("i").alias("__i"), F.max("j").alias("__j"))
    shifted = pick(new, "merge").join(most, PAIR).select(*PAIR, (F.col("i") + F.col("__i") + 1).alias("i"), (F.col("j") + F.col("__j") + 1).alias("j"), "x1", "y1", "x2", "y2")
    merged = filter_matches(pick(old, "merge").unionByName(shifted.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in columns])), "ransac", threshold)
    alone = old.join(what.select(*PAIR), PAIR, "left_anti").unionByName(new.join(what.select(*PAIR), PAIR, "left_anti").join(old.select(*PAIR).distinct(), PAIR, "left_anti"))
    return pick(new, "replace").unionByName(pick(old, "keep")).unionByName(merged).unionByName(alone)


def settle(matches: DataFrame, transforms: DataFrame, order: DataFrame, rounds: int = 1) -> DataFrame:
    """(image, m): transforms with what is left between each image and the one that it was fitted to taken off as well.

    ``matches`` go from the image (image1) to its fixed one (image2), ``order`` has image and fixed. Points of both are taken to
    the registered frame; the fits of what is left are chained to the reference, and follow the image's own transform.
    """
    now = transforms
    for _ in range(rounds):
        inv = now.select("image", A.inverse(F.col("m")).alias("inv"))
        j = matches.join(order.select(F.col("image").alias("image1"), F.col("fixed").alias("image2")), PAIR, "left_semi")
        for k in (1, 2):
            j = j.join(inv.select(F.col("image").alias(f"image{k}"), F.col("inv").alias(f"__inv{k}")), f"image{k}")
            j = j.withColumn(f"__p{k}", A.apply_xy(F.col(f"__inv{k}"), F.col(f"x{k}"), F.col(f"y{k}")))
        # From the fixed image's places to the image's: matrices take the output to its source.
        moved = j.select(*PAIR, F.col("__p2.x").alias("x1"), F.col("__p2.y").alias("y1"), F.col("__p1.x").alias("x2"), F.col("__p1.y").alias("y2"))
        g = guarded(moved, M.fit_similarity(moved))
        step = A.matrix(F.col("a"), -F.col("b"), F.col("tx"), F.col("b"), F.col("a"), F.col("ty"), 0, 0, 1)
        left = chain_to_reference(g.select(F.col("image1").alias("image"), F.col("image2").alias("fixed"), step.alias("m")))
        now = checkpointed(now.join(left.select("image", F.col("m").alias("__m")), "image", "left").select("image", F.when(F.col("__m").isNull(), F.col("m")).otherwise(A.matmul(F.col("m"), F.col("__m"))).alias("m")))
    return now


def best_reflection(matches: DataFrame, w: float, h: float) -> DataFrame:
    """(image1, image2, flip_x, flip_y, err) of the mirror of image 1 after which a fit leaves the smallest median error."""
    flips = F.explode(F.array(*[F.struct(F.lit(a).alias("flip_x"), F.lit(b).alias("flip_y")) for a, b in ((False, False), (True, False), (False, True), (True, True))]))
    each = matches.select("*", flips.alias("f")).select(*PAIR, "f.*", F.when(F.col("f.flip_x"), w - 1 - F.col("x1")).otherwise(F.col("x1")).alias("x1"), F.when(F.col("f.flip_y"), h - 1 - F.col("y1")).otherwise(F.col("y1")).alias("y1"), "x2", "y2")
    key = [*PAIR, "flip_x", "flip_y"]
    tagged = each.select(F.struct("image1", "flip_x", "flip_y").alias("image1"), "image2", "x1", "y1", "x2", "y2")
    err = M.residuals(tagged, M.fit_similarity(tagged)).groupBy("image1", "image2").agg(F.percentile("r", 0.5).alias("err"))
    err = err.select(F.col("image1.image1").alias("image1"), "image2", F.col("image1.flip_x").alias("flip_x"), F.col("image1.flip_y").alias("flip_y"), F.round("err", 6).alias("err"))
    return err.groupBy(*PAIR).agg(F.min(F.struct("err", *key[2:])).alias("best")).select(*PAIR, "best.flip_x", "best.flip_y", "best.err")


def rematch_decision(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per pair: 'replace' if the new matches are more and nearer, 'keep' if neither, 'merge' otherwise. A mean that is less by its
    last digits only is not nearer: the same matches have it where they are added in another order."""
    s = lambda t, k: t.groupBy(*PAIR).agg(F.count(F.lit(1)).alias(f"n_{k}"), F.avg("r").alias(f"d_{k}"))
    both = s(old, "old").join(s(new, "new"), PAIR)
    nearer, more = F.col("d_new") < F.col("d_old") * (1 - 1e-9), F.col("n_new") > F.col("n_old")
    return both.select(*PAIR, "n_old", "n_new", F.when(nearer & more, "replace").when(~nearer & ~more, "keep").otherwise("merge").alias("decision"))


def total_error(errors: DataFrame, order: str, stack: str | None = None) -> DataFrame:
    """Errors of a stack, weighted by how near the middle they are; and by their number of matches. A stack's errors, one an image, are
    ranked in a task; ``stack`` names the column that tells stacks apart."""
    key = [stack] if stack else []
    whole = Window.partitionBy(*(key or [F.lit(0)]))
    e = errors.select(*key, "err", "n", (F.row_number().over(whole.orderBy(order)) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("total"))
    weight = F.col("total") - F.abs(F.col("i") - F.col("total") / 2)
    return e.groupBy(*key).agg((F.sum(weight * F.col("err")) / F.sum(weight)).alias("total_error"), (F.sum(F.col("n") * F.col("err")) / F.sum("n")).alias("mean_by_matches"))


def weighted_median(values: DataFrame) -> DataFrame:
    """The least r of a pair at which half of the weight w is reached."""
    upto = F.sum("w").over(Window.partitionBy(*PAIR).orderBy("r", "i"))
    e = values.select(*PAIR, "r", upto.alias("upto"), F.sum("w").over(Window.partitionBy(*PAIR)).alias("whole"))
    return e.groupBy(*PAIR).agg(F.min(F.when(F.col("upto") >= 0.5 * F.col("whole"), F.col("r"))).alias("weighted_median"))


def grid_motion(matches: DataFrame, cell: float, factor: float) -> DataFrame:
    """Cell-to-cell motions with their support: the matches of the same motion in the 3 x 3 cells around.

    Accepted where support reaches ``factor`` times the root of the mean number of matches a cell.
    """
    c = lambda k: F.floor(F.col(k) / cell).cast("int")
    cells = matches.groupBy(*PAIR, c("x1").alias("cx"), c("y1").alias("cy"), c("x2").alias("ex"), c("y2").alias("ey")).agg(F.count(F.lit(1)).alias("n"))
    own = cells.groupBy(*PAIR, "cx", "cy").agg(F.sum("n").alias("total"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    around = cells.select("*", steps).select(*PAIR, (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), (F.col("ex") + F.col("s.dx")).alias("ex"), (F.col("ey") + F.col("s.dy")).alias("ey"), F.col("n").alias("near"))
    key = [*PAIR, "cx", "cy", "ex", "ey"]
    support = cells.join(around, key).groupBy(*key, "n").agg(F.sum("near").alias("support"))
    return support.join(own, [*PAIR, "cx", "cy"]).select(*key, "n", "support", (F.col("support") >= factor * F.sqrt(F.col("total") / 9)).alias("accepted"))

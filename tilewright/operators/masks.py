"""Masks of images: thresholds, tissue, regions by size and shape, hulls, boxes and outlines.

A mask is a table of its pixels (image, x, y); a frame has a row an image with its width and height (image, w, h).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import colour as C
from tilewright.kernels import images as I
from tilewright.operators import raster as R
from tilewright.operators import stain as S
from tilewright.operators.components import connected_components
from tilewright.operators.tiled import by_tile
from tilewright.session import checkpointed

KEY = ["image", "x", "y"]


def frames(pixels: DataFrame) -> DataFrame:
    """(image, w, h) of images of which all pixels are there."""
    return pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def whole_frame(frame: DataFrame) -> DataFrame:
    """All pixels of each frame."""
    cols = frame.select("image", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1).cast("array<int>")).alias("x"))
    return cols.select("image", "x", F.explode(F.sequence(F.lit(0), F.col("h") - 1).cast("array<int>")).alias("y"))


def thresholds(pixels: DataFrame, value: str, how: str = "otsu", bins: int = 256) -> DataFrame:
    """(image, low, high) of a value's histogram: 'otsu' (low = high), 'multiotsu' (of three classes) or 'li' (low = high).

    Histograms are aggregates of ``bins`` bins between an image's extremes; the kernel gets these alone.
    """
    ends = pixels.groupBy("image").agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    h = pixels.select("image", value).join(ends, "image").groupBy("image", "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("bin")
        lo, hi = float(t["lo"].iloc[0]), float(t["hi"].iloc[0])
        centre, n = lo + (t["bin"].to_numpy() + 0.5) * (hi - lo) / bins, t["n"].to_numpy(float)
        got = [I.li(centre, n)] if how == "li" else I.otsu(centre, n, 3 if how == "multiotsu" else 2)
        return pd.DataFrame({"image": [t["image"].iloc[0]], "low": [got[0]], "high": [got[-1]]})

    return h.groupBy("image").applyInPandas(run, f"image {pixels.schema['image'].dataType.simpleString()}, low double, high double")


def hysteresis_threshold(pixels: DataFrame, value: str, limits: DataFrame) -> DataFrame:
    """(image, x, y): regions over ``low`` that hold a pixel over ``high``."""
    p = pixels.select(*KEY, value).join(limits, "image")
    masks = p.where(F.col(value) > F.col("low")).select(*KEY).unionAll(p.where(F.col(value) > F.col("high")).select(*KEY))
    return R.hysteresis(masks, 2).select(*KEY)


def entropy_thresholds(pixels: DataFrame, value: str) -> DataFrame:
    """(image, low, high): the lesser of the first of two thresholds and of the one of least cross entropy, and the one between two classes."""
    two, li, one = thresholds(pixels, value, "multiotsu"), thresholds(pixels, value, "li"), thresholds(pixels, value)
    j = two.select("image", F.col("low").alias("m")).join(li.select("image", F.col("low").alias("l")), "image").join(one.select("image", F.col("low").alias("o")), "image")
    low = F.least("m", "l")
    return j.select("image", F.least(low, F.col("o")).alias("low"), F.greatest(low, F.col("o")).alias("high"))


def invert(mask: DataFrame, frame: DataFrame) -> DataFrame:
    return whole_frame(frame).join(mask.select(*KEY), KEY, "left_anti")


def touching_edge(regions: DataFrame, frame: DataFrame) -> DataFrame:
    """(image, comp) of the regions that touch the edge of their frame."""
    j = regions.join(frame, "image")
    return j.where((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)).select("image", "comp").distinct()


def fill_holes(mask: DataFrame, frame: DataFrame, tile: int = 512) -> DataFrame:
    """A mask with what it encloses: the 4-connected regions outside it that don't touch the frame's edge."""
    outside = R.components(invert(mask, frame), diagonal=False, tile=tile)
    holes = outside.join(touching_edge(outside, frame), ["image", "comp"], "left_anti").select(*KEY)
    return mask.select(*KEY).unionByName(holes)


def dilate(mask: DataFrame, frame: DataFrame, radius: int) -> DataFrame:
    """A mask grown by a disk, within the frame."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for j, i in I.disk(radius)])).alias("s")
    grown = mask.select(*KEY, steps).select("image", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).where("x >= 0 AND y >= 0").distinct()
    return grown.join(frame, "image").where("x < w AND y < h").select(*KEY)


def filled_outlines(mask: DataFrame, frame: DataFrame, radius: int = 3) -> DataFrame:
    """The filled outlines of a grown mask: where a region touches an edge of the frame, what lies between its first
    and last pixel on that edge closes it."""
    regions = R.components(dilate(mask, frame, radius))
    j = regions.join(frame, "image")
    closed = []
    for along, across, at in (("x", "y", F.lit(0)), ("x", "y", F.col("h") - 1), ("y", "x", F.lit(0)), ("y", "x", F.col("w") - 1)):
        side = j.where(F.col(across) == at).groupBy("image", "comp", F.col(across).alias("at")).agg(F.min(along).alias("a"), F.max(along).alias("b"))
        side = side.select("image", "at", F.explode(F.sequence("a", "b")).alias("k"))
        closed.append(side.select("image", (F.col("k") if along == "x" else F.col("at")).cast("int").alias("x"), (F.col("at") if along == "x" else F.col("k")).cast("int").alias("y")))
    whole = regions.select(*KEY)
    for c in closed:
        whole = whole.unionByName(c)
    return fill_holes(checkpointed(whole.distinct()), frame)


def region_sizes(regions: DataFrame) -> DataFrame:
    """(image, comp, area, x0, y0, x1, y1): numbers of pixels, and boxes with their last pixels."""
    return regions.groupBy("image", "comp").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def by_edge(mask: DataFrame, frame: DataFrame) -> DataFrame:
    """(image, x, y, edge): whether a pixel's region touches the edge of the frame."""
    regions = R.components(mask)
    at = touching_edge(regions, frame).withColumn("edge", F.lit(True))
    return regions.join(at, ["image", "comp"], "left").select(*KEY, F.coalesce("edge", F.lit(False)).alias("edge"))


def large_regions(mask: DataFrame, of_largest: float | None = None, of_frame: tuple[DataFrame, float] | None = None) -> DataFrame:
    """The regions larger than a part of their image's largest one, or than a part of its frame, but the largest one at least."""
    regions = checkpointed(R.components(mask))
    sizes = region_sizes(regions).withColumn("most", F.max("area").over(Window.partitionBy("image")))
    if of_largest is not None:
        kept = sizes.where(F.col("area") > of_largest * F.col("most"))
    else:
        frame, part = of_frame
        s = sizes.join(frame, "image").withColumn("ok", F.col("area") > F.floor(part * F.col("w") * F.col("h")))
        kept = s.withColumn("any", F.max("ok").over(Window.partitionBy("image"))).where(F.col("ok") | (~F.col("any") & (F.col("area") == F.col("most"))))
    return regions.join(kept.select("image", "comp"), ["image", "comp"], "left_semi").select(*KEY)


def hulls(regions: DataFrame) -> DataFrame:
    """(image, comp, area, corners, hull_area): the convex hull of each region, and how many pixels it covers.

    The hull is that of the first and last pixel of each of a region's rows, which is all that the kernel gets.
    """
    rows = regions.groupBy("image", "comp", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        y = t["y"].to_numpy(float)
        corners = I.hull(np.concatenate([np.stack([t["a"].to_numpy(float), y], 1), np.stack([t["b"].to_numpy(float), y], 1)]))
        spans = I.fill_rows(corners)
        return pd.DataFrame({"image": [t["image"].iloc[0]], "comp": [int(t["comp"].iloc[0])], "area": [int(t["n"].sum())], "corners": [[{"x": float(p), "y": float(q)} for p, q in corners]], "hull_area": [int((spans[:, 2] - spans[:, 1] + 1).sum())]})

    return rows.groupBy("image", "comp").applyInPandas(run, f"image {regions.schema['image'].dataType.simpleString()}, comp long, area long, corners array<struct<x: double, y: double>>, hull_area long")


def irregular_regions(mask: DataFrame, least: float = 0.05) -> DataFrame:
    """The regions of which more than the part ``least`` of their hull is missing."""
    regions = checkpointed(R.components(mask))
    kept = hulls(regions).where(1 - F.col("area") / F.col("hull_area") > least)
    return regions.join(kept.select("image", "comp"), ["image", "comp"], "left_semi").select(*KEY)


def hull_mask(mask: DataFrame) -> DataFrame:
    """The pixels that the hulls of a mask's regions cover."""

    def run(batches):  # noqa: ANN001, ANN202
        for t in batches:
            for image, corners in zip(t["image"], t["corners"], strict=True):
                spans = I.fill_rows(np.array([[c["x"], c["y"]] for c in corners]))
                yield pd.DataFrame({"image": image, "y": spans[:, 0], "a": spans[:, 1], "b": spans[:, 2]})

    spans = hulls(R.components(mask)).select("image", "corners").mapInPandas(run, f"image {mask.schema['image'].dataType.simpleString()}, y int, a int, b int")
    return spans.select("image", F.explode(F.sequence("a", "b")).alias("x"), "y").distinct()


def box_mask(mask: DataFrame, merge: bool = True, cell: int = 256) -> DataFrame:
    """(image, x0, y0, x1, y1): boxes of a mask's regions. With ``merge``, boxes that overlap or touch become one
    box, until none do. Boxes meet in the cells of a grid that they cover."""
    boxes = checkpointed(region_sizes(R.components(mask)).select("image", "x0", "y0", "x1", "y1").distinct())
    while merge:
        named = boxes.withColumn("box", F.struct("image", "y0", "x0", "y1", "x1"))
        span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - 1) / cell), F.floor((F.col(b) + 1) / cell)))
        cells = named.select("*", span("x0", "x1").alias("cx")).select("*", span("y0", "y1").alias("cy"))
        near = F.expr("a.image = b.image AND a.cx = b.cx AND a.cy = b.cy AND a.box < b.box AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1 AND a.y0 <= b.y1 + 1 AND b.y0 <= a.y1 + 1")
        pairs = checkpointed(cells.alias("a").join(cells.alias("b"), near).select(F.col("a.box").alias("a"), F.col("b.box").alias("b")).distinct())
        if not pairs.limit(1).count():
            break
        labels = connected_components(pairs)
        group = named.join(labels.withColumnRenamed("node", "box"), "box", "left").withColumn("label", F.coalesce("label", "box"))
        boxes = checkpointed(group.groupBy("image", "label").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("label"))
    return boxes


def without_thin_parts(mask: DataFrame, most: int = 64) -> DataFrame:
    """The regions of a mask that are thick somewhere: that hold a pixel as far from the outside as the threshold of
    least cross entropy of these distances says. Distances end at ``most`` pixels, the margin of a tile."""
    whole = mask.select(*KEY, F.lit(1.0).alias("m"))
    d = by_tile(whole, ["m"], lambda a, there: {"d": I.distance_inside(np.pad(there, 1), most)[1:-1, 1:-1]}, {"d": "double"}, margin=most)
    d = checkpointed(d)
    sure = d.join(thresholds(d, "d", "li"), "image").where(F.col("d") >= F.col("low")).select(*KEY)
    return R.hysteresis(mask.select(*KEY).unionAll(sure), 2).select(*KEY)


def tissue_multichannel(pixels: DataFrame, bands: list[str], q: float = 0.01, filled: bool = False) -> DataFrame:
    """(image, x, y): pixels over the quantile ``q`` of their image in any band, with their holes if asked for."""
    limits = pixels.groupBy("image").agg(*[F.percentile(b, q).alias(f"__q_{b}") for b in bands])
    over: Column = F.lit(False)
    for b in bands:
        over = over | (F.col(b) > F.col(f"__q_{b}"))
    mask = pixels.join(limits, "image").where(over).select(*KEY)
    return fill_holes(mask, frames(pixels)) if filled else mask


def clean_mask(mask: DataFrame, frame: DataFrame, pixels: DataFrame | None = None, bands: list[str] | None = None, part: float = 0.001) -> DataFrame:
    """A mask's regions that are colourful enough, as images go, with their holes, but for those smaller than ``part`` of the frame.

    Regions (with what they enclose) are as colourful as their most colourful pixel; the first of two thresholds of these
    over the mask's pixels parts them. Where none is left, all stay. Without ``pixels`` only sizes count.
    """
    regions = checkpointed(R.components(fill_holes(mask, frame)))
    kept = regions.select(*KEY)
    if pixels is not None:
        c = C.rgb_to_jab(pixels.select(*KEY, *bands), bands, "JzAzBz").select(*KEY, F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("c"))
        most = regions.join(c, KEY).groupBy("image", "comp").agg(F.max("c").alias("c"))
        own = checkpointed(regions.join(most, ["image", "comp"]).join(mask.select(*KEY), KEY, "left_semi").select(*KEY, "comp", "c"))
        several = own.groupBy("image").agg((F.count_distinct("c") > 2).alias("several"))
        limit = thresholds(own, "c", "multiotsu").join(several, "image").select("image", F.when(F.col("several"), F.col("low")).otherwise(F.lit(0.0)).alias("low"))
        good = own.select("image", "comp", "c").distinct().join(limit, "image").where(F.col("c") > F.col("low")).select("image", "comp")
        some = good.select("image").distinct()
        kept = regions.join(good, ["image", "comp"], "left_semi").select(*KEY).unionByName(regions.join(some, "image", "left_anti").select(*KEY))
    return large_regions(kept, of_frame=(frame, part))


def tissue_rgb(pixels: DataFrame, bands: list[str], q: float = 0.99, grey: float = 0.075, light: float = 0.875, dark: float = 0.7) -> DataFrame:
    """(image, x, y): pixels of a colour other than the background's.

    Regions of colourless pixels (under ``grey``) not too light, that hold a dark one, are dirt and edges. The background is
    the mean of the lightest of the others. Distances from it are lowered to the least of their openings along rows and along
    columns of five, which takes lines away; the first of two thresholds of them outside the dirt parts tissue from background.
    """
    jab = C.rgb_to_jab(pixels.select(*KEY, *bands), bands).select(*KEY, "j", "a", "b", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("c"))
    jab = checkpointed(jab)
    dull = jab.where((F.col("c") < grey) & (F.col("j") < light))
    dirt = checkpointed(R.hysteresis(dull.select(*KEY).unionAll(dull.where(F.col("j") < dark).select(*KEY)), 2).select(*KEY))
    coloured = jab.join(dirt, KEY, "left_anti")
    paper = coloured.join(coloured.groupBy("image").agg(F.percentile("j", q).alias("t")), "image").where("j >= t").groupBy("image").agg(*[F.avg(k).alias(f"m{k}") for k in "jab"])
    gap = lambda k: (F.col(k) - F.col(f"m{k}")) * (F.col(k) - F.col(f"m{k}"))
    d = jab.join(paper, "image").select(*KEY, F.sqrt(gap("j") + gap("a") + gap("b")).alias("d"))
    row, column = [(0, i) for i in range(-2, 3)], [(i, 0) for i in range(-2, 3)]
    thin = checkpointed(by_tile(d, ["d"], lambda a, there: {"d": np.minimum(I.opening(a["d"], row), I.opening(a["d"], column))}, {"d": "double"}, margin=4))
    limit = thresholds(thin.join(dirt, KEY, "left_anti"), "d", "multiotsu")
    return thin.join(limit, "image").where(F.col("d") >= F.col("low")).select(*KEY)


def tissue_lightness_colourfulness(pixels: DataFrame, bands: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two masks (image, x, y): tissue, as regions with strong edges far from the background in lightness or
    colourfulness, cleaned; and the hulls of its regions."""
    frame = frames(pixels)
    d = checkpointed(S.lightness_colourfulness_distance(pixels, bands, metric="chebyshev"))
    far = d.join(thresholds(d, "d", "multiotsu"), "image").where(F.col("d") > F.col("low")).select(*KEY)
    edges = checkpointed(by_tile(d, ["d"], lambda a, there: {"e": I.edge_strength(a["d"])}, {"e": "double"}, margin=1))
    strong = edges.join(thresholds(edges, "e"), "image").where(F.col("e") > F.col("low")).select(*KEY)
    mask = clean_mask(filled_outlines(strong.join(far, KEY, "left_semi"), frame), frame, pixels, bands)
    return mask, hull_mask(mask)


def tissue_entropy(pixels: DataFrame, bands: list[str], radius: int = 3, irregular: float = 0.0, of_largest: float = 0.2, space: str = "HunterLab") -> DataFrame:
    """(image, x, y): regions in which lightness varies from pixel to pixel, cleaned by colour, shape and size.

    The background is the dominant colour that is lightest; its pixels have lightness 0.
    """
    frame = frames(pixels)
    colours = checkpointed(S.dominant_colours(pixels, bands, space))
    paper = colours.groupBy("image").agg(F.max_by("colour", F.struct("j", -F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")))).alias("paper"))
    own = S.quantise(pixels, bands, colours, space).select(*KEY, "colour").join(paper, "image")
    jab = C.rgb_to_jab(pixels.select(*KEY, *bands), bands, space).select(*KEY, "j").join(own, [*KEY])
    lit = S.stretched(jab.select(*KEY, F.when(F.col("colour") == F.col("paper"), 0.0).otherwise(F.least(F.greatest("j", F.lit(0.0)), F.lit(1.0))).alias("j")), "j")
    e = checkpointed(by_tile(lit, ["j"], lambda a, there: {"e": I.local_entropy(a["j"], radius, there)}, {"e": "double"}, margin=radius))
    mask = clean_mask(hysteresis_threshold(e, "e", entropy_thresholds(e, "e")), frame, pixels, bands, part=0.0)
    return large_regions(irregular_regions(mask, irregular), of_largest=of_largest)


def remove_background(pixels: DataFrame, value: str, radius: int, dark: bool = False, tile: int = 512) -> DataFrame:
    """(image, x, y, v): what stands out above (or, if ``dark``, below) its surroundings of a disk."""
    offsets = I.disk(radius)

    def run(a: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        img = -a[value] if dark else a[value]
        return {"v": img - I.opening(img, offsets)}

    return by_tile(pixels, [value], run, {"v": "double"}, tile, 2 * radius)


def denoise(pixels: DataFrame, value: str, weight: float | None = None, masked: bool = False, rounds: int = 100, tile: int = 512) -> DataFrame:
    """(image, x, y, v): total variation taken off, by a weight that follows each tile's noise (a fortieth of its
    deviation, or a four-hundredth where ``masked``), stretched to 0 to 255 over the image. What a round takes
    from a pixel depends on its neighbours, so ``rounds`` pixels of margin make tiles exact."""

    def run(a: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        w = weight if weight is not None else I.noise(a[value]) / (400 if masked else 40)
        return {"v": I.total_variation(a[value], w, rounds) if w > 0 else a[value]}

    return S.stretched(by_tile(pixels, [value], run, {"v": "double"}, tile, rounds), "v")

"""Images as tables of pixels: colour, masks, components, histograms and intensity measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.kernels.images import label
from tilewright.operators.components import connected_components
from tilewright.session import checkpointed

EPS = 2.220446049250313e-16


def optical_density(v: Column) -> Column:
    """-log10 of an intensity of 0..255, not below 0."""
    return F.greatest(-F.log10(v / 255.0 + EPS), F.lit(0.0))


def rescale(value: Column, by: Column) -> Column:
    """0..255 between the least and greatest value of ``by``'s group; 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide((value - low) * 255.0, high - low), F.lit(0.0))


def components(mask: DataFrame, diagonal: bool = True, tile: int = 512) -> DataFrame:
    """(image, x, y, comp): 8-connected components of a mask (4-connected if not ``diagonal``), named by their least y * 2^32 + x.

    Tiles are labelled by a kernel, each in a task; only labels that meet across the edges of tiles go through
    rounds of joins, so their cost is that of the edges, not of the pixels.
    """
    image = mask.schema["image"].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        x, y = t["x"].to_numpy().astype(np.int64), t["y"].to_numpy().astype(np.int64)
        x0, y0 = x.min(), y.min()
        there = np.zeros((int(y.max() - y0) + 1, int(x.max() - x0) + 1), bool)
        there[y - y0, x - x0] = True
        first = label(there, diagonal)[y - y0, x - x0]
        return pd.DataFrame({"image": t["image"], "x": x, "y": y, "own": ((first // there.shape[1] + y0) << 32) + first % there.shape[1] + x0})

    at = lambda k: F.floor(F.col(k) / tile).cast("int")
    tiles = mask.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct().withColumns({"tx": at("x"), "ty": at("y")})
    p = checkpointed(tiles.groupBy("image", "tx", "ty").applyInPandas(run, f"image {image}, x int, y int, own bigint"))
    edge = lambda k: F.pmod(F.col(k), F.lit(tile)).isin(0, tile - 1)
    rim = p.where(edge("x") | edge("y"))
    around = [(1, 0), (0, 1), (-1, 1), (1, 1)] if diagonal else [(1, 0), (0, 1)]
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around])).alias("s")
    near = rim.select("image", F.col("own").alias("a"), "x", "y", steps).select("image", "a", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    pairs = near.join(rim, ["image", "x", "y"]).where("a <> own")
    node = lambda c: F.struct("image", F.col(c).alias("own"))
    edges = pairs.select(node("a").alias("a"), node("own").alias("b")).distinct()
    labels = connected_components(edges).select(F.col("node.image").alias("image"), F.col("node.own").alias("own"), F.col("label.own").alias("least"))
    return p.join(labels, ["image", "own"], "left").select("image", "x", "y", F.coalesce("least", "own").alias("comp"))


def combine_masks(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Pixels in either mask ('or') or in both ('and')."""
    return a.union(b).distinct() if how == "or" else a.intersect(b)


def hysteresis(masks: DataFrame, n_masks: int) -> DataFrame:
    """Components of pixels in any mask that hold a pixel in all of them. ``masks`` has a row a mask and pixel."""
    count = masks.groupBy("image", "x", "y").agg(F.count(F.lit(1)).alias("k"))
    comp = components(count)
    seeds = comp.join(count.where(F.col("k") >= n_masks), ["image", "x", "y"]).select("image", "comp").distinct()
    return comp.join(seeds, ["image", "comp"], "left_semi")


def large_components(comp: DataFrame, part: float) -> DataFrame:
    """Components of at least ``part`` of their image's largest one."""
    area = comp.groupBy("image", "comp").agg(F.count(F.lit(1)).alias("area"))
    return area.withColumn("most", F.max("area").over(Window.partitionBy("image"))).where(F.col("area") >= part * F.col("most")).drop("most")


def histogram(pixels: DataFrame, band: str) -> DataFrame:
    """(image, v, n, upto): counts of each value, and the running part of all."""
    h = pixels.groupBy("image", F.col(band).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("image")
    return h.withColumn("upto", F.sum("n").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole))


def match_histograms(src: DataFrame, ref: DataFrame) -> DataFrame:
    """(image, v, matched): for each value the least reference value that as large a part of pixels reaches.

    An as-of join of two running parts: both go into one sorted run of an image, where the answer is
    the nearest reference row at or above.
    """
    a = src.select("image", "upto", "v", F.lit(1).alias("kind"))
    b = ref.select("image", "upto", "v", F.lit(0).alias("kind"))
    w = Window.partitionBy("image").orderBy(F.desc("upto"), F.desc("kind"), F.desc("v"))
    above = F.last(F.when(F.col("kind") == 0, F.col("v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Equal parts: the reference row comes after the source row in that order, so it is looked up on its own.
    same = F.min(F.when(F.col("kind") == 0, F.col("v"))).over(Window.partitionBy("image", "upto"))
    return a.unionByName(b).withColumn("matched", F.coalesce(same, above)).where("kind = 1").select("image", "v", "matched")


def shannon(pixels: DataFrame, band: str, n_bins: int) -> DataFrame:
    """Pixels with the self-information of their bin in their image."""
    bin_ = F.round(F.col(band) / 255.0 * (n_bins - 1)).cast("int")
    b = pixels.withColumn("bin", bin_)
    share = F.count(F.lit(1)).over(Window.partitionBy("image", "bin")) / F.count(F.lit(1)).over(Window.partitionBy("image"))
    return b.withColumn("info", -F.log(share))


def mutual_information(pixels: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """(image, h_a, h_b, h_ab, nmi) from one pass of grouping sets over the joint bins; nmi is (h_a + h_b) / h_ab."""
    t = pixels.select("image", F.floor(F.col(a) * bins / 256).cast("int").alias("p"), F.floor(F.col(b) * bins / 256).cast("int").alias("q"))
    sets = t.groupingSets([["image", "p", "q"], ["image", "p"], ["image", "q"]], "image", "p", "q").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("image", "g"))
    h = sets.select("image", "g", (-share * F.log(share)).alias("h")).groupBy("image", "g").agg(F.sum("h").alias("h"))
    of = lambda g: F.max(F.when(F.col("g") == g, F.col("h")))
    m = h.groupBy("image").agg(of(1).alias("h_a"), of(2).alias("h_b"), of(0).alias("h_ab"))
    return m.withColumn("nmi", F.try_divide(F.col("h_a") + F.col("h_b"), F.col("h_ab")))


def shapes(pixels: DataFrame, value: str) -> DataFrame:
    """(image, n, lo, hi, w, h, is_empty): sizes of images, and which are empty: of one value only."""
    g = pixels.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return g.withColumn("is_empty", F.col("lo") == F.col("hi"))


def applied_mask(value: Column, mask: Column) -> Column:
    """A value within a mask, 0 outside it."""
    return F.when(mask, value).otherwise(0)


def overlap(*masks: Column) -> Column:
    """How many of some masks hold a pixel."""
    return sum((m.cast("int") for m in masks[1:]), masks[0].cast("int"))


def coverage(masks: DataFrame, images: int | None = None) -> DataFrame:
    """(x, y, n_images, in_all): of each place the number of images of which the mask (image, x, y) holds it, and whether all do."""
    n = images if images is not None else masks.select("image").distinct().count()
    c = masks.select("image", "x", "y").distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_images"))
    return c.withColumn("in_all", F.col("n_images") == n)


def bounding_box(places: DataFrame) -> DataFrame:
    """(x, y, w, h) of some places."""
    return places.agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def consensus_mask(pixels: DataFrame, value: str, least: int = 2) -> DataFrame:
    """(x, y): places that ``least`` images have a value at, where these are, weighted by how bright they are among their image's
    values, at least half of what the best place has."""
    top = pixels.groupBy("image").agg(F.max(value).cast("double").alias("top"))
    p = pixels.where(F.col(value) > 0).join(top, "image").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) / F.col("top")).alias("weight")).where(F.col("n") >= least)
    best = p.agg(F.max("weight").alias("best"))
    return p.crossJoin(F.broadcast(best)).where(2 * F.col("weight") >= F.col("best")).select("x", "y")


def pooled_statistics(pixels: DataFrame, value: str, percents: tuple[int, ...] = (1, 5, 95, 99)) -> DataFrame:
    """(percent, levels, mean): of the pooled histogram of all images, the number of values up to given percentages, and the mean.

    Only the histogram, a row a value, meets in one task.
    """
    h = pixels.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    c = h.select("v", "n", (F.sum("n").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole)).alias("upto"))
    c = c.select("*", F.explode(F.array(*[F.lit(q) for q in percents])).alias("percent"))
    return c.groupBy("percent").agg(F.count_if(F.col("upto") <= F.col("percent") / 100.0).alias("levels"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))


def joint_histogram(pixels: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """(image, p, q, n): joint histogram of two bands, of bins between their extremes, with both margins, which have a null for the other band."""
    ends = pixels.groupBy("image").agg(*[f(c).cast("double").alias(f"__{n}_{k}") for k, c in (("p", a), ("q", b)) for n, f in (("lo", F.min), ("hi", F.max))])
    cut = lambda c, k: F.floor(F.try_divide(F.col(c) - F.col(f"__lo_{k}"), F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * bins * (1 - 1e-9)).cast("int").alias(k)
    t = pixels.select("image", a, b).join(ends, "image").select("image", cut(a, "p"), cut(b, "q"))
    return t.groupingSets([["image", "p", "q"], ["image", "p"], ["image", "q"]], "image", "p", "q").agg(F.count(F.lit(1)).alias("n"))


def mean_squared_error(pixels: DataFrame, a: str, b: str, mask: Column | None = None) -> DataFrame:
    """(image, mse, masked_mse): of two bands, over all pixels and over those of ``mask``."""
    e = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return pixels.groupBy("image").agg(F.avg(e).alias("mse"), F.avg(F.when(mask, e) if mask is not None else e).alias("masked_mse"))


def otsu(pixels: DataFrame, value: str) -> DataFrame:
    """(image, threshold, between_var): the value that parts an image's histogram with the largest variance between both sides, the least of equals."""
    h = pixels.groupBy("image", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("image")
    upto = own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    vn = F.col("v") * F.col("n")
    r = h.select("image", "v", F.sum("n").over(upto).alias("c"), F.sum(vn).over(upto).alias("s"), F.sum("n").over(own).alias("tc"), F.sum(vn).over(own).alias("ts")).where("tc > c")
    gap = F.col("s") / F.col("c") - (F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c"))
    e = r.select("image", "v", F.round(F.col("c").cast("double") * (F.col("tc") - F.col("c")) * F.pow(gap, 2) / (F.col("tc").cast("double") * F.col("tc")), 6).alias("between_var"))
    return e.groupBy("image").agg(F.max(F.struct("between_var", (-F.col("v")).alias("back"))).alias("m")).select("image", (-F.col("m.back")).alias("threshold"), F.col("m.between_var").alias("between_var"))


def unimodal_threshold(pixels: DataFrame, value: str) -> DataFrame:
    """(image, threshold, distance): the corner of a histogram: farthest from the line from its peak to its last value."""
    h = pixels.groupBy("image", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    p = h.groupBy("image").agg(F.max(F.struct("n", (-F.col("v")).alias("b"))).alias("peak"), F.max(F.struct("v", "n")).alias("last"))
    p = p.select("image", (-F.col("peak.b")).alias("v0"), F.col("peak.n").alias("n0"), F.col("last.v").alias("v9"), F.col("last.n").alias("n9"))
    f = lambda c: F.col(c).cast("double")
    gap = F.abs((f("n9") - f("n0")) * f("v") - (f("v9") - f("v0")) * f("n") + f("v9") * f("n0") - f("n9") * f("v0")) / F.sqrt(F.pow(f("n9") - f("n0"), 2) + F.pow(f("v9") - f("v0"), 2))
    e = h.join(p, "image").where("v >= v0 AND v9 > v0").select("image", "v", F.round(gap, 6).alias("d"))
    return e.groupBy("image").agg(F.max(F.struct("d", (-F.col("v")).alias("b"))).alias("m")).select("image", (-F.col("m.b")).alias("threshold"), F.col("m.d").alias("distance"))


def elbow(curve: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x): where a falling curve's steps change least from one to the next, the first of equals."""
    w = Window.partitionBy(key).orderBy(x)
    step = F.lead(y).over(w) - F.col(y)
    e = curve.withColumn("__s", step).withColumn("__d", F.abs(F.lead("__s").over(w) - F.col("__s"))).where("__d IS NOT NULL")
    return e.groupBy(key).agg(F.min(F.struct("__d", x)).alias("m")).select(key, F.col(f"m.{x}").alias(x))


def downsampled(pixels: DataFrame, bands: list[str], k: int = 2) -> DataFrame:
    """Images at a ``k``-th of the size: means of ``k`` by ``k`` pixels."""
    at = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return pixels.groupBy("image", at("x"), at("y")).agg(*[F.avg(b).alias(b) for b in bands])


def pyramid(pixels: DataFrame, bands: list[str], levels: int) -> DataFrame:
    """(image, level, x, y, *bands): images and their halves, level by level; sums and counts go on, so each level is a mean of pixels."""
    now = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.col(b).cast("double").alias(b) for b in bands])
    out = now.withColumn("level", F.lit(0))
    for k in range(1, levels):
        now = downsampled(now, bands)
        out = out.unionByName(now.withColumn("level", F.lit(k)))
    return out.select("image", "level", "x", "y", *bands)


def cropped(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The pixels of a box, of which the first one becomes (0, 0)."""
    p = pixels.where((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    return p.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def padded(pixels: DataFrame, frame: DataFrame, bands: list[str], fill: int = 0) -> DataFrame:
    """Images in the middle of larger frames (image, w, h), of their own size (in_w, in_h), ``fill`` around."""
    cells = frame.select("image", "h", "in_w", "in_h", "w", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    cells = cells.select("image", "x", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.floor((F.col("w") - F.col("in_w")) / 2).alias("dx"), F.floor((F.col("h") - F.col("in_h")) / 2).alias("dy"))
    src = pixels.select("image", F.col("x").alias("__x"), F.col("y").alias("__y"), *bands)
    j = cells.withColumns({"__x": (F.col("x") - F.col("dx")).cast("int"), "__y": (F.col("y") - F.col("dy")).cast("int")}).join(src, ["image", "__x", "__y"], "left")
    return j.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.coalesce(F.col(b), F.lit(fill)).alias(b) for b in bands])


def resized_nearest(pixels: DataFrame, sizes: DataFrame, bands: list[str]) -> DataFrame:
    """Images at another size, each pixel the nearest one of the source. ``sizes`` has image, in_w, in_h, w and h."""
    cells = sizes.select("image", "in_w", "in_h", "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    at = lambda c, n, s: F.least(F.floor((F.col(c) + 0.5) * F.col(s) / F.col(n)), F.col(s) - 1).cast("int")
    cells = cells.select("image", "x", "y", at("x", "w", "in_w").alias("__x"), at("y", "h", "in_h").alias("__y"))
    src = pixels.select("image", F.col("x").alias("__x"), F.col("y").alias("__y"), *bands)
    return cells.join(src, ["image", "__x", "__y"]).select("image", "x", "y", *bands)


def histogram_peaks(pixels: DataFrame, value: str, width: int) -> DataFrame:
    """(image, hue, n, rank): local peaks of an image's histogram of bins of ``width``, the most frequent first."""
    b = pixels.groupBy("image", F.floor(F.col(value) / width).cast("int").alias("hue")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("image")
    peaks = b.withColumns({"p": F.lag("n").over(own.orderBy("hue")), "q": F.lead("n").over(own.orderBy("hue"))}).where("n > coalesce(p, 0) AND n >= coalesce(q, 0)")
    return peaks.select("image", "hue", "n", F.row_number().over(own.orderBy(F.desc("n"), "hue")).alias("rank"))


def blended(pixels: DataFrame, value: str, colours: list[Column]) -> DataFrame:
    """(x, y, c0, c1, ...): images laid over each other, each in its colour (expressions over its row) in proportion to its part of the pixel's sum."""
    total = pixels.groupBy("x", "y").agg(F.sum(value).cast("double").alias("__total"))
    part = F.try_divide(F.col(value).cast("double"), F.col("__total")) * F.col(value)
    return pixels.join(total, ["x", "y"]).groupBy("x", "y").agg(*[F.sum(part * c).alias(f"c{k}") for k, c in enumerate(colours)])


def tinted(value: Column, colour: tuple[float, float, float], top: float = 255.0) -> Column:
    """struct(r, g, b): a grey of 0 to ``top`` in shades of a colour of 0 to 1."""
    return F.struct(*[(value / top * c).alias(n) for n, c in zip("rgb", colour, strict=True)])


def background_pixel(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(image, x, y, darkest): the pixel of least summed intensity, the first of equals, row by row."""
    total = sum((F.col(b) for b in bands[1:]), F.col(bands[0]))
    m = pixels.groupBy("image").agg(F.min(F.struct(total.alias("s"), "y", "x")).alias("m"))
    return m.select("image", F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.s").alias("darkest"))


def multichannel_colours(pixels: DataFrame, bands: list[str], colours: list[tuple[float, float, float]]) -> DataFrame:
    """(image, x, y, r, g, b): bands, each stretched over its image, in their colours of 0 to 1, in proportion to their parts of the pixel's sum."""
    ends = pixels.groupBy("image").agg(*[f(b).cast("double").alias(f"__{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))])
    unit = {b: F.coalesce(F.try_divide(F.col(b) - F.col(f"__lo_{b}"), F.col(f"__hi_{b}") - F.col(f"__lo_{b}")), F.lit(0.0)) for b in bands}
    p = pixels.join(ends, "image").select("image", "x", "y", *[v.alias(f"__u_{b}") for b, v in unit.items()])
    total = sum((F.col(f"__u_{b}") for b in bands[1:]), F.col(f"__u_{bands[0]}"))
    mix = lambda k: sum((F.col(f"__u_{b}") * F.coalesce(F.try_divide(F.col(f"__u_{b}"), total), F.lit(0.0)) * c[k] for b, c in zip(bands, colours, strict=True)), F.lit(0.0))
    return p.select("image", "x", "y", *[F.least(mix(k), F.lit(1.0)).alias(n) for k, n in enumerate("rgb")])


def outline(mask: DataFrame) -> DataFrame:
    """(image, x, y): pixels of a mask that have one of their four neighbours outside it."""
    m = mask.select("image", "x", "y").distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    near = m.select("image", "x", "y", steps).select("image", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    full = near.groupBy("image", "x", "y").agg(F.count(F.lit(1)).alias("k")).where("k = 4")
    return m.join(full, ["image", "x", "y"], "left_anti")


def equalise_adaptive(pixels: DataFrame, value: str, regions: int = 8, clip: float = 0.01, bins: int = 256) -> DataFrame:
    """(image, x, y, v): values of 0 to 255 equalised by the histograms of their surroundings.

    Each image is a grid of ``regions`` a side. A region's histogram is cut at the part ``clip`` of its pixels (one at least), what is cut off
    goes to all bins alike, and its running sum maps values to 0 to 255. A pixel's value is mapped by the four regions whose middles
    are around it, each as near as it is. Histograms are aggregates; maps and pixels meet by the cells between regions' middles.
    """
    frame = pixels.groupBy("image").agg(F.ceil((F.max("x") + 1) / regions).alias("__rw"), F.ceil((F.max("y") + 1) / regions).alias("__rh"))
    bin_of = F.least(F.greatest(F.floor(F.col(value) * bins / 256.0), F.lit(0)), F.lit(bins - 1)).cast("int")
    p = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), bin_of.alias("bin")).join(frame, "image")
    h = p.groupBy("image", F.floor(F.col("x") / F.col("__rw")).cast("int").alias("i"), F.floor(F.col("y") / F.col("__rh")).cast("int").alias("j"), "bin").agg(F.count(F.lit(1)).alias("n"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(t["bin"], t["n"], bins).astype(float)
        limit = max(clip * n.sum(), 1.0)
        over = np.maximum(n - limit, 0).sum()
        n = np.minimum(n, limit) + over / bins
        return pd.DataFrame({"image": [t["image"].iloc[0]], "i": [t["i"].iloc[0]], "j": [t["j"].iloc[0]], "map": [(np.cumsum(n) / n.sum() * 255).tolist()]})

    image = pixels.schema["image"].dataType.simpleString()
    maps = checkpointed(h.groupBy("image", "i", "j").applyInPandas(run, f"image {image}, i int, j int, map array<double>"))
    ends = maps.groupBy("image").agg(F.max("i").alias("__i"), F.max("j").alias("__j"))
    # A cell lies between four middles; beyond the outermost ones the nearest counts for both.
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
    cells = ends.select("image", "__i", "__j", F.explode(F.sequence(F.lit(-1), F.col("__i"))).alias("ci")).select("*", F.explode(F.sequence(F.lit(-1), F.col("__j"))).alias("cj")).select("*", at)
    near = lambda c, o, last: F.least(F.greatest(F.col(c) + F.col(o), F.lit(0)), F.col(last)).cast("int")
    cells = cells.select("image", "ci", "cj", "o.a", "o.b", near("ci", "o.a", "__i").alias("i"), near("cj", "o.b", "__j").alias("j")).join(maps, ["image", "i", "j"])
    pick = lambda a, b: F.first(F.when((F.col("a") == a) & (F.col("b") == b), F.col("map")), ignorenulls=True).alias(f"m{a}{b}")
    cells = checkpointed(cells.groupBy("image", "ci", "cj").agg(*[pick(a, b) for a in (0, 1) for b in (0, 1)]))
    place = {"gx": (F.col("x") + 0.5) / F.col("__rw") - 0.5, "gy": (F.col("y") + 0.5) / F.col("__rh") - 0.5}
    p = p.withColumns(place).withColumns({"ci": F.floor("gx").cast("int"), "cj": F.floor("gy").cast("int")})
    j = p.join(cells, ["image", "ci", "cj"])
    fx, fy = F.col("gx") - F.col("ci"), F.col("gy") - F.col("cj")
    of = lambda a, b: F.get(F.col(f"m{a}{b}"), F.col("bin"))
    mixed = (of(0, 0) * (1 - fx) + of(1, 0) * fx) * (1 - fy) + (of(0, 1) * (1 - fx) + of(1, 1) * fx) * fy
    return j.select("image", "x", "y", mixed.alias("v"))

"""Colours and stains of images: lightness, distances from the background, unmixing, flattening, quantising.

Images are tables of pixels: image, x, y and a column a band, 0 to 255. Statistics of an image come from
aggregates, and meet its pixels in a join by image; what is computed from them alone (stain vectors, clusters) is a
kernel over a handful of rows an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import colour as C
from tilewright.kernels import colour as KC
from tilewright.kernels import points as K
from tilewright.operators.raster import optical_density as density_of

KEY = ["image", "x", "y"]
# Weights of red, green and blue in a grey; stains of a reference slide and its 99th percentiles.
GREY = (0.2125, 0.7154, 0.0721)
STAIN_CEILING = (1.9705, 1.0308)


def _with(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """Pixels beside the one row of their image."""
    return pixels.join(stats, "image")


def stretched(pixels: DataFrame, value: str, low: float = 0.0, high: float = 255.0, whole: bool = True) -> DataFrame:
    """``value`` between the least and the greatest of its image, as whole numbers if so asked; 0 where all are equal."""
    ends = pixels.groupBy("image").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    v = F.coalesce(F.try_divide((F.col(value) - F.col("__lo")).cast("double"), (F.col("__hi") - F.col("__lo")).cast("double")), F.lit(0.0)) * (high - low) + low
    return _with(pixels, ends).withColumn(value, F.floor(v).cast("int") if whole else v).drop("__lo", "__hi")


def optical_density(pixels: DataFrame, bands: list[str], q: float = 0.95) -> DataFrame:
    """(image, x, y, od): the mean density of the bands, cut at the quantile ``q`` of the image."""
    total = sum((density_of(F.col(b)) for b in bands[1:]), density_of(F.col(bands[0])))
    od = pixels.select(*KEY, (total / len(bands)).alias("od"))
    return _with(od, od.groupBy("image").agg(F.percentile("od", q).alias("top"))).select(*KEY, F.least("od", "top").alias("od"))


def grey(bands: list[str]) -> Column:
    """Weighted sum of red, green and blue, of 0 to 1."""
    r, g, b = (F.col(f"`{c}`") / 255.0 * w for c, w in zip(bands, GREY, strict=True))
    return r + g + b


def luminosity(pixels: DataFrame, bands: list[str], invert: bool = True) -> DataFrame:
    """(image, x, y, v): lightness as it is seen, of 0 to 255, dark on light turned round, stretched over each image."""
    j = F.col("j") * 255.0
    lit = C.rgb_to_jab(pixels.select(*KEY, *bands), bands).select(*KEY, (255.0 - j if invert else j).alias("v"))
    return stretched(lit, "v")


def standardise_colourfulness(pixels: DataFrame, bands: list[str], c: float = 0.2, h: float = 0.0, invert: bool = True) -> DataFrame:
    """(image, x, y, v): greys of the image with one colourfulness and hue (radians) for all pixels."""
    lit = C.rgb_to_jab(pixels.select(*KEY, *bands), bands).select(*KEY, "j", F.lit(float(c * np.cos(h))).alias("a"), F.lit(float(c * np.sin(h))).alias("b"))
    rgb = C.jab_to_rgb(lit, ["j", "a", "b"]).select(*KEY, *[F.floor(F.col(p) * 255).alias(p) for p in "rgb"])
    v = grey(["r", "g", "b"])
    return stretched(rgb.select(*KEY, (1 - v if invert else v).alias("v")), "v")


def background_distance(pixels: DataFrame, bands: list[str], q: float = 0.99, space: str = "CAM16UCS") -> DataFrame:
    """(image, x, y, d): distance of a pixel's colour from the mean of those of which the lightness is the quantile ``q`` of the image or more."""
    jab = C.rgb_to_jab(pixels.select(*KEY, *bands), bands, space).select(*KEY, "j", "a", "b")
    top = jab.groupBy("image").agg(F.percentile("j", q).alias("t"))
    paper = _with(jab, top).where("j >= t").groupBy("image").agg(*[F.avg(c).alias(f"m{c}") for c in "jab"])
    gap = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "ab"), (F.col("j") - F.col("mj")) * (F.col("j") - F.col("mj")))
    return _with(jab, paper).select(*KEY, F.sqrt(gap).alias("d"))


def lightness_colourfulness_distance(pixels: DataFrame, bands: list[str], p: float = 99, metric: str = "euclidean", space: str = "IHLS") -> DataFrame:
    """(image, x, y, d): distance of lightness and colourfulness, each stretched to 0 to 1 in its image, from the
    ``p``-th percentile of the one and the (100 - ``p``)-th of the other, which are the background's."""
    src = pixels.select(*KEY, *bands)
    if space == "IHLS":
        hls = C.rgb_to_ihls(*[F.col(f"`{b}`") for b in bands])
        jc = src.select(*KEY, hls.alias("v")).select(*KEY, F.col("v.luminance").alias("j"), F.col("v.saturation").alias("c"))
    else:
        jc = C.rgb_to_jab(src, bands, space).select(*KEY, "j", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("c"))
    jc = stretched(stretched(jc, "j", 0, 1, whole=False), "c", 0, 1, whole=False)
    paper = jc.groupBy("image").agg(F.percentile("j", p / 100).alias("pj"), F.percentile("c", 1 - p / 100).alias("pc"))
    dj, dc = F.abs(F.col("j") - F.col("pj")), F.abs(F.col("c") - F.col("pc"))
    d = {"euclidean": F.sqrt(dj * dj + dc * dc), "chebyshev": F.greatest(dj, dc), "manhattan": dj + dc}[metric]
    return _with(jc, paper).select(*KEY, d.alias("d"))


def unmix(pixels: DataFrame, bands: list[str], matrix: np.ndarray, out: str = "stain") -> DataFrame:
    """(image, x, y, stain1, stain2, ...): optical densities of the bands times a matrix (bands, stains), see
    ``kernels.colour.unmixing_matrix``."""
    od = [density_of(F.col(f"`{b}`")) for b in bands]
    stain = lambda k: sum((od[i] * float(matrix[i, k]) for i in range(1, len(bands))), od[0] * float(matrix[0, k]))
    return pixels.select(*KEY, *[stain(k).alias(f"{out}{k + 1}") for k in range(matrix.shape[1])])


def stain_vectors(pixels: DataFrame, bands: list[str], light: float = 240.0, alpha: float = 1.0, beta: float = 0.15) -> DataFrame:
    """(image, vectors): two stains of each image as six numbers, (red, green, blue) of the first and of the second.

    Of the pixels of which all densities are ``beta`` or more, the densities' plane of largest variance is found from
    their covariances, and the stains are the angles in it at the percentiles ``alpha`` and 100 - ``alpha``. The stain
    with more red comes first. Covariances and percentiles are aggregates; between them is a row an image.
    """
    n = len(bands)
    od = pixels.select("image", *[(-F.log((F.col(f"`{b}`") + 1.0) / light)).alias(f"d{i}") for i, b in enumerate(bands)])
    od = od.where(" AND ".join(f"d{i} >= {beta}" for i in range(n)))
    moments = od.groupBy("image").agg(*[F.covar_samp(f"d{i}", f"d{j}").alias(f"c{i}{j}") for i in range(n) for j in range(i, n)])

    def plane(batches):  # noqa: ANN001, ANN202
        for t in batches:
            rows = []
            for r in t.to_dict("records"):
                c = np.nan_to_num(np.array([[r[f"c{min(i, j)}{max(i, j)}"] for j in range(n)] for i in range(n)], float))
                v = np.linalg.eigh(c)[1][:, -2:]
                v *= np.where(v.sum(axis=0) < 0, -1, 1)  # the sign of an eigenvector is free
                rows.append((r["image"], v[:, 0].tolist(), v[:, 1].tolist()))
            yield pd.DataFrame(rows, columns=["image", "e1", "e2"])

    image = pixels.schema["image"].dataType.simpleString()
    axes = moments.mapInPandas(plane, f"image {image}, e1 array<double>, e2 array<double>")
    along = lambda e: sum((F.col(f"d{i}") * F.get(F.col(e), F.lit(i)) for i in range(1, n)), F.col("d0") * F.get(F.col(e), F.lit(0)))
    angles = od.join(axes, "image").select("image", "e1", "e2", F.atan2(along("e2"), along("e1")).alias("phi"))
    ends = angles.groupBy("image", "e1", "e2").agg(F.percentile("phi", F.array(F.lit(alpha / 100), F.lit(1 - alpha / 100))).alias("phi"))
    at = lambda k: F.zip_with("e1", "e2", lambda a, b: a * F.cos(F.get("phi", F.lit(k))) + b * F.sin(F.get("phi", F.lit(k))))
    ends = ends.select("image", at(0).alias("low"), at(1).alias("high"))
    red = F.get("low", F.lit(0)) > F.get("high", F.lit(0))
    return ends.select("image", F.when(red, F.concat("low", "high")).otherwise(F.concat("high", "low")).alias("vectors"))


def stain_concentrations(pixels: DataFrame, bands: list[str], vectors: DataFrame, light: float = 240.0) -> DataFrame:
    """(image, x, y, first, second): how much of each of its image's two stains a pixel holds, by least squares,
    so that the 99th percentile is that of a reference slide."""
    n = len(bands)
    v = lambda s, i: F.get("vectors", F.lit(s * n + i))
    dot = lambda a, b: sum((a(i) * b(i) for i in range(1, n)), a(0) * b(0))
    own = vectors.select("image", "vectors", *[dot(lambda i, s=s: v(s, i), lambda i, t=t: v(t, i)).alias(f"g{s}{t}") for s, t in ((0, 0), (0, 1), (1, 1))])
    p = pixels.select(*KEY, *[(-F.log((F.col(f"`{b}`") + 1.0) / light)).alias(f"d{i}") for i, b in enumerate(bands)]).join(own, "image")
    p = p.select(*KEY, "g00", "g01", "g11", *[dot(lambda i: F.col(f"d{i}"), lambda i, s=s: v(s, i)).alias(f"h{s}") for s in (0, 1)])
    det = F.col("g00") * F.col("g11") - F.col("g01") * F.col("g01")
    p = p.select(*KEY, F.try_divide(F.col("g11") * F.col("h0") - F.col("g01") * F.col("h1"), det).alias("first"), F.try_divide(F.col("g00") * F.col("h1") - F.col("g01") * F.col("h0"), det).alias("second"))
    top = p.groupBy("image").agg(F.percentile("first", 0.99).alias("t1"), F.percentile("second", 0.99).alias("t2"))
    part = lambda c, t, ceiling: F.try_divide(F.col(c), F.col(t) / ceiling).alias(c)
    return _with(p, top).select(*KEY, part("first", "t1", STAIN_CEILING[0]), part("second", "t2", STAIN_CEILING[1]))


def haematoxylin_eosin(pixels: DataFrame, bands: list[str], stain: str = "hem", light: float = 240.0, alpha: float = 1.0, beta: float = 0.15) -> DataFrame:
    """(image, x, y, v): one of the two stains of each image, of 0 to 255."""
    column = {"hem": "first", "eos": "second"}[stain]
    c = stain_concentrations(pixels, bands, stain_vectors(pixels, bands, light, alpha, beta), light)
    return c.select(*KEY, F.least(F.greatest(F.coalesce(F.col(column), F.lit(0.0)) * light, F.lit(0.0)), F.lit(255.0)).alias("v"))


def dominant_colours(pixels: DataFrame, bands: list[str], space: str = "JzAzBz", least_colourfulness: float = 0.005, least_share: float = 1e-4, bins: int = 50, most: int = 5, n: int | None = None) -> DataFrame:
    """(image, colour, n, a, b, j): the colours that stand out in each image, the most frequent first.

    The opponent parts of an image's colourful enough pixels are binned on a grid of ``bins`` a side, between their
    extremes; bins with a share of ``least_share`` or more are clustered, weighted, from far points on. The number of
    clusters is ``n``, or where the clusters' spread stops falling clearly, at ``most``. A kernel gets an image's bins.
    """
    jab = C.rgb_to_jab(pixels.select("image", *bands), bands, space).select("image", "j", "a", "b").where(F.col("a") * F.col("a") + F.col("b") * F.col("b") >= least_colourfulness**2)
    ends = jab.groupBy("image").agg(*[f(c).alias(f"{name}_{c}") for c in "ab" for name, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("total"))
    bin_of = lambda c: F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    h = jab.join(ends, "image").select("image", "total", bin_of("a").alias("ba"), bin_of("b").alias("bb"), "j", "a", "b")
    h = h.groupBy("image", "total", "ba", "bb").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "jab"]).where(F.col("n") >= least_share * F.col("total"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["ba", "bb"])
        v, w = t[["a", "b"]].to_numpy(float), t["n"].to_numpy(float)
        k = min(n, len(v)) if n else K.estimate_clusters(v, w, most)
        centres = K.weighted_kmeans(v, w, k)
        label = ((v[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        size = np.bincount(label, w, len(centres))
        j = np.bincount(label, w * t["j"].to_numpy(float), len(centres)) / np.maximum(size, 1)
        order = [o for o in np.lexsort((np.arange(len(centres)), -size)) if size[o] > 0]
        return pd.DataFrame({"image": t["image"].iloc[0], "colour": np.arange(len(order)), "n": size[order].astype(int), "a": centres[order, 0], "b": centres[order, 1], "j": j[order]})

    return h.groupBy("image").applyInPandas(run, f"image {pixels.schema['image'].dataType.simpleString()}, colour int, n long, a double, b double, j double")


def quantise(pixels: DataFrame, bands: list[str], colours: DataFrame, space: str = "JzAzBz", lightness: float = 1.0) -> DataFrame:
    """(image, x, y, colour, r, g, b): each pixel with its own lightness and the nearest of its image's colours, of
    0 to 255. ``colours`` (image, colour, a, b) has a handful of rows an image, which meet its pixels as one array."""
    lists = colours.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("colour", F.col("a").alias("ca"), F.col("b").alias("cb")))).alias("all"))
    p = C.rgb_to_jab(pixels.select(*KEY, *bands), bands, space).select(*KEY, "j", "a", "b").join(lists, "image")
    gap = lambda s: (s["ca"] - F.col("a")) * (s["ca"] - F.col("a")) + (s["cb"] - F.col("b")) * (s["cb"] - F.col("b"))
    p = p.select(*KEY, "j", F.array_min(F.transform("all", lambda s: F.struct(gap(s).alias("d"), s["colour"].alias("colour"), s["ca"].alias("ca"), s["cb"].alias("cb")))).alias("m"))
    p = p.select(*KEY, F.col("m.colour").alias("colour"), (F.col("j") * lightness).alias("j"), F.col("m.ca").alias("a"), F.col("m.cb").alias("b"))
    out = C.jab_to_rgb(p, ["j", "a", "b"], space, ("r", "g", "bl"))
    return out.select(*KEY, "colour", F.floor(F.col("r") * 255).cast("int").alias("r"), F.floor(F.col("g") * 255).cast("int").alias("g"), F.floor(F.col("bl") * 255).cast("int").alias("b"))


def colour_similarity(pixels: DataFrame, bands: list[str], colours: list[tuple[int, int, int]], how: str = "similarity", space: str = "JzAzBz") -> DataFrame:
    """(image, x, y, colour1, colour2, ...): how like each pixel is to each of some colours of 0 to 255.

    'similarity' is 1 less the distance of the colours, 'norm' the cosine of their angle, both in parts that are
    stretched to 0 to 1 over the image; 'similarity' is stretched again over all colours of the image.
    'deconvolve' is how much of each there is by optical density.
    """
    if how == "deconvolve":
        return unmix(pixels, bands, KC.unmixing_matrix(np.array(colours)), "colour")
    jab = C.rgb_to_jab(pixels.select(*KEY, *bands), bands, space).select(*KEY, "j", "a", "b")
    ends = jab.groupBy("image").agg(*[f(c).alias(f"{name}_{c}") for c in "jab" for name, f in (("lo", F.min), ("hi", F.max))])
    p = _with(jab, ends)
    unit = lambda v, c: F.coalesce(F.try_divide(v - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))
    own = [unit(F.col(c), c) for c in "jab"]
    values = []
    for colour in KC.rgb_to_jab(np.array(colours, float) / 255, space):
        other = [unit(F.lit(float(v)), c) for v, c in zip(colour, "jab", strict=True)]
        dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        gap = [a - b for a, b in zip(own, other, strict=True)]
        values.append(F.sqrt(dot(gap, gap)) if how == "similarity" else F.try_divide(dot(own, other), F.sqrt(dot(own, own) * dot(other, other))))
    names = [f"colour{k + 1}" for k in range(len(values))]
    p = p.select(*KEY, *[v.alias(n) for v, n in zip(values, names, strict=True)])
    if how != "similarity":
        return p
    least = lambda f, g: F.expr(f"{g}({', '.join(f'{f}({n})' for n in names)})") if len(names) > 1 else F.expr(f"{f}({names[0]})")
    ends = p.groupBy("image").agg(least("min", "least").alias("lo"), least("max", "greatest").alias("hi"))
    return _with(p, ends).select(*KEY, *[(1 - F.coalesce(F.try_divide(F.col(n) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).alias(n) for n in names])


def flatten_stains(pixels: DataFrame, bands: list[str], n: int = 16, q: float = 0.95, mask: DataFrame | None = None) -> DataFrame:
    """(image, x, y, v): the mean of an image's unmixed colours, each cut at its quantile ``q`` and stretched to
    1 there, of 0 to 255 over the image.

    The colours are clusters of the image's colours, binned 16 to a band, and the mean of what is not in ``mask``
    (image, x, y), if there is one. Their number is bounded by ``n``, so an image's unmixing matrix is a row.
    """
    inside = pixels if mask is None else pixels.join(mask.select(*KEY), KEY, "left_semi")
    b = [F.floor(F.col(f"`{c}`") / 16).cast("int").alias(f"__b{i}") for i, c in enumerate(bands)]
    h = inside.select("image", *b, *bands).groupBy("image", *[f"__b{i}" for i in range(len(bands))]).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(bands)])
    if mask is not None:
        paper = pixels.join(mask.select(*KEY), KEY, "left_anti").groupBy("image").agg(*[F.avg(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(bands)])
        h = h.unionByName(paper.select("image", *[F.lit(-1).alias(f"__b{i}") for i in range(len(bands))], F.lit(0).cast("long").alias("__n"), *[f"__m{i}" for i in range(len(bands))]))
    means = [f"__m{i}" for i in range(len(bands))]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values([f"__b{i}" for i in range(len(bands))])
        own, paper = t[t["__n"] > 0], t[t["__n"] == 0]
        rgb = np.zeros((0, len(bands)))
        if len(own):
            jab = KC.rgb_to_jab(own[means].to_numpy(float) / 255)
            spread = np.maximum(jab.std(axis=0), 1e-9)
            centres = K.weighted_kmeans(jab / spread, own["__n"].to_numpy(float), min(n, len(own))) * spread
            rgb = np.unique(np.clip(KC.jab_to_rgb(centres), 0, 1) * 255, axis=0)
        d = KC.unmixing_matrix(np.concatenate([rgb, paper[means].to_numpy(float)]))
        return pd.DataFrame({"image": [t["image"].iloc[0]], "matrix": [d.T.tolist()]})

    matrices = h.groupBy("image").applyInPandas(run, f"image {pixels.schema['image'].dataType.simpleString()}, matrix array<array<double>>")
    od = F.array(*[density_of(F.col(f"`{c}`")) for c in bands])
    part = pixels.select(*KEY, od.alias("od")).join(matrices, "image")
    part = part.select(*KEY, F.transform("matrix", lambda row: F.aggregate(F.zip_with(row, "od", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).alias("parts"))
    each = part.select("image", F.posexplode("parts").alias("k", "v")).groupBy("image", "k").agg(F.percentile("v", q).alias("top"))
    tops = each.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("k", "top"))).alias("tops"))
    cut = F.zip_with("parts", "tops", lambda v, t: F.least(F.greatest(v, F.lit(0.0)), F.greatest(t["top"], F.lit(0.0)) + KC.EPS) / (F.greatest(t["top"], F.lit(0.0)) + KC.EPS))
    mean = F.aggregate(cut, F.lit(0.0), lambda s, x: s + x) / F.size("parts")
    return stretched(part.join(tops, "image").select(*KEY, mean.alias("v")), "v")


def segment_colours(pixels: DataFrame, bands: list[str], j: tuple[float, float], c: tuple[float, float], h: tuple[float, float], space: str = "JzAzBz", rotation: float = 0.0) -> DataFrame:
    """(image, x, y): pixels of which lightness, colourfulness and hue (degrees, turned by ``rotation``) lie within the ranges, ends included."""
    p = C.rgb_to_jab(pixels.select(*KEY, *bands), bands, space)
    p = p.select(*KEY, C.polar(F.col("j"), F.col("a"), F.col("b"), rotation).alias("v"))
    return p.where(F.col("v.j").between(*j) & F.col("v.c").between(*c) & F.col("v.h").between(*h)).select(*KEY)


def dominant_hues(pixels: DataFrame, bands: list[str], space: str = "JzAzBz", least_colourfulness: float = 0.005, least_share: float = 1e-4, bins: int = 360, apart: int = 18) -> DataFrame:
    """(image, hue, n, rank): local peaks of each image's circle of hues, ``apart`` bins from any higher one, the most
    frequent first. Bins of a smaller share of the colourful pixels than ``least_share`` don't count."""
    p = C.rgb_to_jab(pixels.select("image", *bands), bands, space).select("image", C.polar(F.col("j"), F.col("a"), F.col("b")).alias("v")).where(F.col("v.c") >= least_colourfulness)
    h = p.groupBy("image", F.least(F.floor(F.col("v.h") / 360 * bins), F.lit(bins - 1)).cast("int").alias("hue")).agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumn("total", F.sum("n").over(Window.partitionBy("image"))).where(F.col("n") >= least_share * F.col("total")).drop("total")
    near = F.explode(F.sequence(F.lit(-apart), F.lit(apart))).alias("d")
    around = h.select("image", "hue", "n", near).select("image", F.pmod(F.col("hue") + F.col("d"), F.lit(bins)).alias("hue"), F.struct("n", (-F.col("hue")).alias("back")).alias("s"))
    best = around.groupBy("image", "hue").agg(F.max("s").alias("s"))
    peaks = h.join(best, ["image", "hue"]).where(F.col("s.back") == -F.col("hue")).drop("s")
    return peaks.select("image", "hue", "n", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), "hue")).alias("rank"))

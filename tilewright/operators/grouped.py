"""Operators that hand a group of rows to a NumPy kernel: a tile with its margin, or the matches of a pair of images.

Groups are bounded by their nature, whatever the size of an image: tiles have a side of some hundred pixels, pairs some
thousand matches, stacks a row for each two of their images.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.kernels import images as I
from tilewright.kernels import points as K
from tilewright.operators import fields as D
from tilewright.operators.tiled import by_tile, with_margin

#: Up to so many images, the row that an image's statistics make up is broadcast.
BROADCAST_IMAGES = 100_000
# Intensities beyond the range of pixels, at which curves end in themselves.
CURVE_ENDS = (300.0, 450.0)


def ransac_filter(matches: DataFrame, threshold: float = 7.0, rounds: int = 500, seed: int = 0) -> DataFrame:
    """Matches that agree with the homography of their pair; pairs of fewer than four pass."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["i", "j"])
        return t[K.ransac(t[["x1", "y1"]].to_numpy(), t[["x2", "y2"]].to_numpy(), threshold, rounds, seed)]

    columns = ["image1", "image2", "i", "j", "x1", "y1", "x2", "y2"]
    m = matches.select(*columns)
    return m.groupBy("image1", "image2").applyInPandas(run, m.schema)


def dense(t: pd.DataFrame, value: str) -> np.ndarray:
    """An array of an image's pixels; those without a row are 0."""
    out = np.zeros((int(t["y"].max()) + 1, int(t["x"].max()) + 1))
    out[t["y"].to_numpy(), t["x"].to_numpy()] = t[value].to_numpy()
    return out


#: Corners (image, n -> places and responses) and descriptors (image, places -> rows) by name.
CORNERS = {"harris": I.harris, "fast": I.fast_corners}
DESCRIPTORS = {"patch": I.patch_descriptors, "binary": I.binary_descriptors}


def detect(pixels: DataFrame, value: str, n: int = 500, tile: int = 512, mask: DataFrame | None = None, corners: str = "harris", descriptor: str = "patch") -> DataFrame:
    """(image, kp, x, y, response, descr): an image's ``n`` strongest corners with descriptors: patches, or bits to be compared by the metric 'hamming'.

    Corners are found and described tile by tile, with as wide a margin as smoothing, comparison with neighbours and
    patches need; then they are ranked over the image. With a ``mask`` (image, x, y), only those within it.
    """
    margin = 32
    src = with_margin(pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v")), tile, margin)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        tx, ty, x0, y0 = int(t["tx"].iloc[0]), int(t["ty"].iloc[0]), int(t["x"].min()), int(t["y"].min())
        img = dense(pd.DataFrame({"x": t["x"] - x0, "y": t["y"] - y0, "v": t["v"]}), "v")
        none = pd.DataFrame({"image": [], "x": [], "y": [], "response": [], "descr": pd.Series([], dtype=object)})
        if min(img.shape) < 2:
            return none
        xy, r = CORNERS[corners](img, img.size)
        own = ((xy[:, 0] + x0) // tile == tx) & ((xy[:, 1] + y0) // tile == ty)
        xy, r = xy[own][:n], r[own][:n]  # no more of a tile can be among the image's strongest
        if not len(xy):
            return none
        return pd.DataFrame({"image": t["image"].iloc[0], "x": xy[:, 0] + x0, "y": xy[:, 1] + y0, "response": r, "descr": list(DESCRIPTORS[descriptor](img, xy))})

    image = pixels.schema["image"].dataType.simpleString()
    found = src.groupBy("image", "tx", "ty").applyInPandas(run, f"image {image}, x double, y double, response double, descr array<double>")
    if mask is not None:
        inside = mask.select("image", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        found = found.join(inside, ["image", "x", "y"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("response"), "y", "x"))
    return found.withColumn("kp", (rank - 1).cast("int")).where(F.col("kp") < n).select("image", "kp", "x", "y", "response", "descr")


def flow(pixels: DataFrame, fixed: str, moving: str, tile: int = 512, buffer: int = 100, sigma: float = 1.0) -> DataFrame:
    """(image, x, y, dx, dy): the backward field that takes ``moving`` to ``fixed``, tile by tile.

    A tile's pixels come with a buffer around, of which the field is cut off again. Constant tiles stay still.
    """

    def run(a: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        f, m = a[fixed], a[moving]
        still = f.min() == f.max() or m.min() == m.max() or min(f.shape) < 3
        d = np.zeros((2, *f.shape)) if still else I.gaussian_field(I.optical_flow(f, m), sigma)
        return {"dx": d[0], "dy": d[1]}

    return by_tile(pixels, [fixed, moving], run, {"dx": "double", "dy": "double"}, tile, buffer)


def invert_fields(field: DataFrame) -> DataFrame:
    """(slide, gx, gy, dx, dy): the inverse of each slide's field on a whole grid."""
    return D.invert(field)


def smooth_fields(field: DataFrame, sigma: float) -> DataFrame:
    """(slide, gx, gy, dx, dy): each slide's field, smoothed."""
    return D.smooth(field, sigma)


def normalise(pixels: DataFrame, value: str, target: list[float] | None = None) -> DataFrame:
    """(image, x, y, v): images with the percentiles of all images pooled, or those given, by a smooth curve through their own.

    The curve has a handful of knots an image; pixels are mapped by Arrow batches beside them.
    """
    qs = F.array(*[F.lit(q) for q in (0.01, 0.05, 0.5, 0.95, 0.99)])
    own = pixels.groupBy("image").agg(F.percentile(value, qs).alias("own"))
    if target is None:
        target = pixels.agg(F.percentile(value, qs)).first()[0]
    if target is None:
        return pixels.select("image", "x", "y", F.lit(None).cast("int").alias("v"))
    to = [float(x) for x in target]
    if own.count() <= BROADCAST_IMAGES:
        own = F.broadcast(own)
    j = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v")).join(own, "image")

    def run(batches):  # noqa: ANN001, ANN202
        for t in batches:
            out = np.zeros(len(t))
            for _, rows in t.groupby("image").indices.items():
                knots = np.concatenate([[0.0], np.asarray(t["own"].iloc[rows[0]], float), CURVE_ENDS])
                x, first = np.unique(knots, return_index=True)
                out[rows] = np.clip(K.akima(x, np.concatenate([[0.0], to, CURVE_ENDS])[first], t["v"].to_numpy()[rows]), 0, 255)
            yield t[["image", "x", "y"]].assign(v=np.floor(out).astype(int))

    return j.mapInPandas(run, f"image {pixels.schema['image'].dataType.simpleString()}, x int, y int, v int")


def dominant_colours(pixels: DataFrame, bands: list[str], k: int = 3, bin_side: int = 16) -> DataFrame:
    """(image, colour, n, centre): clusters of an image's colour histogram, the largest first.

    The histogram is made by an aggregate, so the kernel gets at most its bins, whatever the image's size.
    """
    b = [F.floor(F.col(c) / bin_side).cast("int").alias(c) for c in bands]
    h = pixels.select("image", *b).groupBy("image", *bands).agg(F.count(F.lit(1)).alias("n"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(bands)
        v, n = (t[bands].to_numpy(float) + 0.5) * bin_side, t["n"].to_numpy(float)
        c = K.weighted_kmeans(v, n, k)
        label = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        size = np.bincount(label, n, len(c))
        order = np.lexsort((np.arange(len(c)), -size))
        return pd.DataFrame({"image": t["image"].iloc[0], "colour": np.arange(len(c)), "n": size[order].astype(int), "centre": [list(np.round(c[o], 6)) for o in order]})

    return h.groupBy("image").applyInPandas(run, f"image {pixels.schema['image'].dataType.simpleString()}, colour int, n long, centre array<double>")


def order_stack(matrix: DataFrame, stack: str | None = None) -> DataFrame:
    """(image, place), with the stack's column if there is one: the images of a stack in an order that keeps like ones together.

    The distance matrix (a, b, distance) has a row a pair of slides of one stack, or of each by a column ``stack``;
    images without a common pair are at the largest distance. A stack is a task, of a few hundred images.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(t["a"]) | set(t["b"]))
        at = {n: i for i, n in enumerate(names)}
        d = np.full((len(names), len(names)), max(float(t["distance"].max()), 1.0))
        np.fill_diagonal(d, 0)
        i, j = t["a"].map(at).to_numpy(), t["b"].map(at).to_numpy()
        d[i, j] = d[j, i] = t["distance"].to_numpy(float)
        order = K.leaf_order(d)
        return pd.DataFrame({"stack": t["stack"].iloc[0], "image": [names[k] for k in order], "place": range(len(order))})

    m = matrix.select((F.col(stack) if stack else F.lit(0)).alias("stack"), "a", "b", "distance")
    kind, image = m.schema["stack"].dataType.simpleString(), m.schema["a"].dataType.simpleString()
    out = m.groupBy("stack").applyInPandas(run, f"stack {kind}, image {image}, place int")
    return out.withColumnRenamed("stack", stack) if stack else out.drop("stack")

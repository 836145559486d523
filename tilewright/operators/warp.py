"""Warping of points, geometries and rasters between slides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import affine as A
from tilewright.kernels.resample import sample
from tilewright.operators.tiled import with_margin


def with_inverse(transforms: DataFrame) -> DataFrame:
    """(slide, m, inv): the inverse is worked out once a slide, before slides meet their points."""
    return transforms.select("slide", "m", A.inverse(F.col("m")).alias("inv"))


def _moved(points: DataFrame, place: Column, sx: Column | float = 1.0, sy: Column | float = 1.0) -> list[Column]:
    p = place
    return [*(F.col(c) for c in points.columns), (p["x"] * sx).alias("wx"), (p["y"] * sy).alias("wy")]


def warp_points(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Points on slides in the registered frame, as wx and wy. ``transforms`` (slide, m) has a row a slide."""
    j = points.join(with_inverse(transforms).select("slide", "inv"), "slide")
    j = j.select(*points.columns, A.apply_xy(F.col("inv"), F.col("x"), F.col("y")).alias("__p"))
    return j.select(*_moved(points, F.col("__p")))


def unwarp_points(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Points of the registered frame on their slides, as wx and wy."""
    j = points.join(transforms.select("slide", "m"), "slide").select(*points.columns, A.apply_xy(F.col("m"), F.col("x"), F.col("y")).alias("__p"))
    return j.select(*_moved(points, F.col("__p")))


def warp_between(points: DataFrame, transforms: DataFrame, to_slide: Column) -> DataFrame:
    """Points of a slide on another one: into the registered frame, then onto ``to_slide``. The product of both
    matrices is worked out once a pair of slides."""
    p = points.withColumn("to_slide", to_slide)
    own, there = with_inverse(transforms).select("slide", "inv"), transforms.select(F.col("slide").alias("to_slide"), F.col("m").alias("to_m"))
    pairs = p.select("slide", "to_slide").distinct().join(own, "slide").join(there, "to_slide").select("slide", "to_slide", A.matmul(F.col("to_m"), F.col("inv")).alias("__m"))
    j = p.join(pairs, ["slide", "to_slide"]).select(*points.columns, "to_slide", A.apply_xy(F.col("__m"), F.col("x"), F.col("y")).alias("__p"))
    return j.select(*points.columns, "to_slide", F.col("__p.x").alias("wx"), F.col("__p.y").alias("wy"))


def warp_scaled(points: DataFrame, transforms: DataFrame, src: float, reg: float) -> DataFrame:
    """Points given at another size of the slide: scaled to the size of the fit, warped, scaled to the output."""
    j = points.join(with_inverse(transforms).select("slide", "inv"), "slide")
    j = j.select(*points.columns, A.apply_xy(F.col("inv"), F.col("x") / src, F.col("y") / src).alias("__p"))
    return j.select(*_moved(points, F.col("__p"), reg, reg))


def scaling_factors(slides: DataFrame) -> DataFrame:
    """``slides`` with src_sx, src_sy, field_sx, field_sy, dst_sx and dst_sy: what points are divided by to come to the size of
    the fit, multiplied by to come to the field's, and then to the output's.

    Sizes are columns of pairs _w and _h: fit (the image that was fitted), pt (that the points are of), reg (the registered
    image), field (its field, if any) and out (that the points go to). Without one of them there is nothing to scale.
    """
    have = set(slides.columns)

    def ratio(a: str, b: str, k: str) -> Column:
        if f"{a}_{k}" not in have or f"{b}_{k}" not in have:
            return F.lit(1.0)
        return F.coalesce(F.col(f"{a}_{k}").cast("double") / F.col(f"{b}_{k}"), F.lit(1.0))

    out = "out" if "out_w" in have else "reg"
    out_of = lambda k: ratio(out, "field", k) if "field_w" in have else ratio(out, "reg", k)
    return slides.withColumns(
        {f"{n}_s{x}": f(k) for n, f in (("src", lambda k: ratio("pt", "fit", k)), ("field", lambda k: ratio("field", "reg", k)), ("dst", out_of)) for x, k in (("x", "w"), ("y", "h"))}
    )


def _shift(slides: DataFrame) -> DataFrame:
    missing = [c for c in ("crop_x", "crop_y") if c not in slides.columns]
    return slides.withColumns({c: F.lit(0.0) for c in missing}) if missing else slides


def warp_xy(points: DataFrame, slides: DataFrame, forward: DataFrame | None = None, cell: float = 1.0, order: int = 1) -> DataFrame:
    """Points on slides in the registered frame, as wx and wy: to the size of the fit, under the matrix' inverse, to the
    size of the field, moved by the forward field there, to the size of the output, less the crop's corner.

    ``slides`` has slide and m, the sizes that ``scaling_factors`` names, and crop_x and crop_y, all but the first two if needed.
    """
    factors = ["src_sx", "src_sy", "field_sx", "field_sy", "dst_sx", "dst_sy"]
    s = _shift(scaling_factors(slides)).select("slide", A.inverse(F.col("m")).alias("__inv"), *[F.col(c).alias(f"__{c}") for c in (*factors, "crop_x", "crop_y")])
    j = points.join(s, "slide").withColumn("__p", A.apply_xy(F.col("__inv"), F.col("x") / F.col("__src_sx"), F.col("y") / F.col("__src_sy")))
    j = j.select(*[F.col(c).alias(f"__own_{c}") if c in "xy" else F.col(c) for c in points.columns], (F.col("__p.x") * F.col("__field_sx")).alias("x"), (F.col("__p.y") * F.col("__field_sy")).alias("y"), *[f"__{c}" for c in ("dst_sx", "dst_sy", "crop_x", "crop_y")])
    j = displace(j, forward, cell, order) if forward is not None else j.withColumns({"wx": F.col("x"), "wy": F.col("y")})
    back = [F.col(f"__own_{c}").alias(c) if c in "xy" else F.col(c) for c in points.columns]
    return j.select(*back, (F.col("wx") * F.col("__dst_sx") - F.col("__crop_x")).alias("wx"), (F.col("wy") * F.col("__dst_sy") - F.col("__crop_y")).alias("wy"))


def unwarp_xy(points: DataFrame, slides: DataFrame, back: DataFrame | None = None, cell: float = 1.0, order: int = 1) -> DataFrame:
    """Points of the registered frame on their slides, as wx and wy: the steps of ``warp_xy`` in turn, with the backward field."""
    factors = ["src_sx", "src_sy", "field_sx", "field_sy", "dst_sx", "dst_sy"]
    s = _shift(scaling_factors(slides)).select("slide", F.col("m").alias("__m"), *[F.col(c).alias(f"__{c}") for c in (*factors, "crop_x", "crop_y")])
    j = points.join(s, "slide")
    place = [((F.col(k) + F.col(f"__crop_{k}")) / F.col(f"__dst_s{k}")).alias(k) for k in "xy"]
    j = j.select(*[F.col(c).alias(f"__own_{c}") if c in "xy" else F.col(c) for c in points.columns], *place, "__m", *[f"__{c}" for c in factors[:4]])
    j = displace(j, back, cell, order) if back is not None else j.withColumns({"wx": F.col("x"), "wy": F.col("y")})
    j = j.withColumn("__p", A.apply_xy(F.col("__m"), F.col("wx") / F.col("__field_sx"), F.col("wy") / F.col("__field_sy")))
    own = [F.col(f"__own_{c}").alias(c) if c in "xy" else F.col(c) for c in points.columns]
    return j.select(*own, (F.col("__p.x") * F.col("__src_sx")).alias("wx"), (F.col("__p.y") * F.col("__src_sy")).alias("wy"))


def warp_xy_between(points: DataFrame, slides: DataFrame, to_slide: Column, forward: DataFrame | None = None, back: DataFrame | None = None, cell: float = 1.0, order: int = 1) -> DataFrame:
    """Points of a slide on ``to_slide``, as wx and wy: through the registered frame, with both slides' fields and sizes."""
    p = points.withColumns({"to_slide": to_slide, "__x": F.col("x"), "__y": F.col("y")})
    there = warp_xy(p, slides.drop("crop_x", "crop_y"), forward, cell, order)
    there = there.select(F.col("slide").alias("__from"), F.col("to_slide").alias("slide"), *[c for c in points.columns if c not in ("slide", "x", "y")], "__x", "__y", F.col("wx").alias("x"), F.col("wy").alias("y"))
    gone = unwarp_xy(there, slides.drop("crop_x", "crop_y"), back, cell, order)
    own = {"slide": F.col("__from"), "x": F.col("__x"), "y": F.col("__y")}
    return gone.select(*[own.get(c, F.col(c)).alias(c) for c in points.columns], F.col("slide").alias("to_slide"), "wx", "wy")


def displace(points: DataFrame, field: DataFrame, cell: float, order: int = 1) -> DataFrame:
    """Points moved by a displacement field on a grid of ``cell`` pixels, interpolated bilinearly, or by cubic
    convolution if ``order`` is 3.

    ``field`` (slide, gx, gy, dx, dy) holds the grid's values; a point without all four neighbours stays.
    """
    if order == 3:
        return _displace_cubic(points, field, cell)
    gx, gy = F.floor(F.col("x") / cell).cast("int"), F.floor(F.col("y") / cell).cast("int")
    p = points.withColumns({"__gx": gx, "__gy": gy, "__fx": F.col("x") / cell - gx, "__fy": F.col("y") / cell - gy})
    # One join: each grid value goes to the four cells that it is a corner of.
    ends = F.explode(F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy")) for a in (0, 1) for b in (0, 1)])).alias("o")
    cells = field.select("slide", "gx", "gy", "dx", "dy", ends).select("slide", (F.col("gx") - F.col("o.ox")).alias("__gx"), (F.col("gy") - F.col("o.oy")).alias("__gy"), "o.ox", "o.oy", "dx", "dy")
    at = lambda v, a, b: F.sum(F.when((F.col("ox") == a) & (F.col("oy") == b), F.col(v)))
    corner = cells.groupBy("slide", "__gx", "__gy").agg(F.count(F.lit(1)).alias("__n"), *[at(v, a, b).alias(f"__{v}{a}{b}") for v in ("dx", "dy") for a in (0, 1) for b in (0, 1)]).where("__n = 4").drop("__n")
    fx, fy = F.col("__fx"), F.col("__fy")
    mixed = lambda v: (F.col(f"__{v}00") * (1 - fx) + F.col(f"__{v}10") * fx) * (1 - fy) + (F.col(f"__{v}01") * (1 - fx) + F.col(f"__{v}11") * fx) * fy
    # Values are as many as cells of all fields, of which Spark's estimate, that of the slides before they are exploded, knows nothing.
    j = p.join(corner.hint("merge"), ["slide", "__gx", "__gy"], "left")
    return j.select(*points.columns, (F.col("x") + F.coalesce(mixed("dx"), F.lit(0.0))).alias("wx"), (F.col("y") + F.coalesce(mixed("dy"), F.lit(0.0))).alias("wy"))


def _displace_cubic(points: DataFrame, field: DataFrame, cell: float, tile: int = 256) -> DataFrame:
    """Points and grid meet by tiles of the grid, with a margin of two values; a kernel interpolates."""
    at = lambda k: F.floor(F.floor(F.col(k) / cell) / tile).cast("int")
    p = points.withColumns({"__tx": at("x"), "__ty": at("y")})
    g = with_margin(field.select("slide", F.col("gx").cast("int").alias("x"), F.col("gy").cast("int").alias("y"), "dx", "dy"), tile, 2).withColumnsRenamed({"slide": "__of", "tx": "__ux", "ty": "__uy"})

    key, columns = ["slide", "__tx", "__ty"], points.columns

    def run(own: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        x, y = own["x"].to_numpy(float), own["y"].to_numpy(float)
        move = np.zeros((len(own), 2))
        if len(own) and len(grid):
            x0, y0 = int(grid["x"].min()), int(grid["y"].min())
            values = np.zeros((int(grid["y"].max()) - y0 + 1, int(grid["x"].max()) - x0 + 1, 2))
            values[grid["y"].to_numpy() - y0, grid["x"].to_numpy() - x0] = grid[["dx", "dy"]].to_numpy()
            u, v = x / cell - x0, y / cell - y0
            inside = (u >= 0) & (v >= 0) & (u <= values.shape[1] - 1) & (v <= values.shape[0] - 1)
            move[inside] = sample(values, u[inside], v[inside], 3)
        return own[columns].assign(wx=x + move[:, 0], wy=y + move[:, 1])

    schema = T.StructType(list(points.schema.fields)).add("wx", "double").add("wy", "double")
    return p.groupBy(*key).cogroup(g.groupBy("__of", "__ux", "__uy")).applyInPandas(run, schema)


def warp_raster_nearest(pixels: DataFrame, m: Column, w: int | None, h: int | None, bands: list[str], fill: int = 0) -> DataFrame:
    """Images under ``m``, destination to source: each output pixel takes its nearest source pixel, or ``fill``.

    The output has ``w`` x ``h`` pixels; None is the image's own extent."""
    images = pixels.groupBy("image").agg((F.max("x") if w is None else F.lit(w - 1)).alias("w"), (F.max("y") if h is None else F.lit(h - 1)).alias("h"))
    out = images.select("image", F.explode(F.sequence(F.lit(0), F.col("w"))).alias("x"), "h").select("image", "x", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("y"))
    s = out.withColumn("s", A.apply_xy(m, F.col("x").cast("double"), F.col("y").cast("double")))
    s = s.select("image", "x", "y", F.floor(F.col("s.x") + 0.5).cast("int").alias("sx"), F.floor(F.col("s.y") + 0.5).cast("int").alias("sy"))
    src = pixels.select("image", F.col("x").alias("sx"), F.col("y").alias("sy"), *bands)
    return s.join(src, ["image", "sx", "sy"], "left").select("image", "x", "y", *[F.coalesce(F.col(b), F.lit(fill)).alias(b) for b in bands])


def warped_canvas(sizes: DataFrame, keys: tuple[str, ...] = ("slide",)) -> DataFrame:
    """(*keys, out_w, out_h) of a frame that holds an image's warped corners. ``sizes`` has the keys, m, w and h."""
    own = sizes.select(*keys, "w", "h", A.inverse(F.col("m")).alias("__inv"))
    c = own.select(*keys, F.transform(A.corners(F.col("w"), F.col("h")), lambda p: A.apply_xy(F.col("__inv"), p["x"], p["y"])).alias("c"))
    ends = {f"{n}_{k}": f(F.col("c")[k]) for n, f in (("min", F.array_min), ("max", F.array_max)) for k in "xy"}
    size = lambda k: F.ceil(F.round(F.greatest(F.col(f"max_{k}"), F.lit(0.0)) - F.least(F.col(f"min_{k}"), F.lit(0.0)), 6))
    return c.select(*keys, *[v.alias(n) for n, v in ends.items()]).select(*keys, size("x").alias("out_w"), size("y").alias("out_h"))


def source_frame(slides: DataFrame) -> DataFrame:
    """``slides`` with src_w, src_h and scaled: the size of an image that, under the matrix ``scaled``, lands in a frame of dst_w by dst_h
    as one of fit_w by fit_h does under m in one of reg_w by reg_h."""
    sx, sy = F.col("dst_w") / F.col("reg_w"), F.col("dst_h") / F.col("reg_h")
    s = slides.withColumns({"scaled": A.scaled(F.col("m"), sx, sy), "__inv": A.inverse(F.col("m"))})
    s = s.withColumn("__c", F.transform(A.corners(F.col("fit_w"), F.col("fit_h")), lambda p: A.apply_xy(F.col("__inv"), p["x"], p["y"])))
    s = s.withColumn("__c", F.transform("__c", lambda p: A.apply_xy(F.col("scaled"), p["x"] * sx, p["y"] * sy)))
    most = lambda k: F.round(F.array_max(F.col("__c")[k])).cast("int")
    return s.withColumns({"src_w": most("x"), "src_h": most("y")}).drop("__inv", "__c")


def warp_map(frames: DataFrame, field: DataFrame | None = None) -> DataFrame:
    """(slide, x, y, sx, sy): of each pixel of a frame (slide, m, w, h) the place in the source that it comes from: by the field's
    displacement there, then by the matrix."""
    cells = frames.select("slide", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1).cast("array<int>")).alias("x")).select("slide", "x", F.explode(F.sequence(F.lit(0), F.col("h") - 1).cast("array<int>")).alias("y"))
    at = [F.col("x").cast("double"), F.col("y").cast("double")]
    if field is not None:
        f = field.select("slide", F.col("gx").alias("x"), F.col("gy").alias("y"), "dx", "dy")
        cells = cells.join(f, ["slide", "x", "y"], "left")
        at = [at[0] + F.coalesce("dx", F.lit(0.0)), at[1] + F.coalesce("dy", F.lit(0.0))]
    s = cells.join(frames.select("slide", "m"), "slide").select("slide", "x", "y", A.apply_xy(F.col("m"), *at).alias("p"))
    return s.select("slide", "x", "y", F.col("p.x").alias("sx"), F.col("p.y").alias("sy"))


#: How many brackets a geometry's coordinates lack of a list of polygons.
DEPTH = {"Point": 3, "MultiPoint": 2, "LineString": 2, "LinearRing": 2, "MultiLineString": 1, "Polygon": 1, "MultiPolygon": 0}
FEATURES = "features array<string>"
VERTICES = "array<array<array<array<double>>>>"


def geojson_vertices(docs: DataFrame) -> DataFrame:
    """(slide, feature, member, type, part, ring, vertex, x, y): the vertices of all features of ``docs`` (slide, geojson).

    ``member`` numbers the geometries of a collection, and is -1 for others. A type that isn't known is an error.
    """
    f = docs.select("slide", F.from_json("geojson", FEATURES).alias("g")).select("slide", F.posexplode("g.features").alias("feature", "f"))
    f = f.select("slide", "feature", F.get_json_object("f", "$.geometry").alias("g"))
    kind = F.get_json_object("g", "$.type")
    members = F.when(kind == "GeometryCollection", F.from_json(F.get_json_object("g", "$.geometries"), "array<string>"))
    f = f.select("slide", "feature", F.explode(F.coalesce(F.transform(members, lambda m, i: F.struct(i.alias("member"), m.alias("g"))), F.array(F.struct(F.lit(-1).alias("member"), F.col("g").alias("g"))))).alias("m"))
    f = f.select("slide", "feature", "m.member", F.get_json_object("m.g", "$.type").alias("type"), F.get_json_object("m.g", "$.coordinates").alias("c"))
    lack = F.create_map(*[x for k, v in DEPTH.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]
    lack = F.when(lack.isNull(), F.raise_error(F.concat(F.lit("unknown geometry "), F.coalesce("type", F.lit("null")))).cast("int")).otherwise(lack)
    f = f.withColumn("n", lack).withColumn("v", F.from_json(F.concat(F.repeat(F.lit("["), F.col("n")), F.col("c"), F.repeat(F.lit("]"), F.col("n"))), VERTICES))
    f = f.select("slide", "feature", "member", "type", F.posexplode("v").alias("part", "p")).select("slide", "feature", "member", "type", "part", F.posexplode("p").alias("ring", "r"))
    return f.select("slide", "feature", "member", "type", "part", "ring", F.posexplode("r").alias("vertex", "xy")).select(
        "slide", "feature", "member", "type", "part", "ring", "vertex", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y")
    )


def warp_geometries(docs: DataFrame, warp: Callable[[DataFrame], DataFrame], digits: int = 3) -> DataFrame:
    """(slide, feature, geometry, properties): features of any geometry, as JSON text, of which ``warp`` has moved all
    vertices (x, y to wx, wy). Properties stay as they are."""
    v = warp(geojson_vertices(docs))
    xy = F.array(F.round("wx", digits) + 0.0, F.round("wy", digits) + 0.0)

    def gather(df: DataFrame, keys: list[str], n: str, value: Column, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(n), value.alias("v")))), lambda s: s["v"]).alias(name))

    own = ["slide", "feature", "member", "type"]
    rings = gather(v, [*own, "part", "ring"], "vertex", xy, "c")
    parts = gather(rings, [*own, "part"], "ring", F.col("c"), "c")
    whole = gather(parts, own, "part", F.col("c"), "c")
    lack = F.create_map(*[x for k, d in DEPTH.items() for x in (F.lit(k), F.lit(d))])[F.col("type")]
    text = F.to_json("c")
    one = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","coordinates":'), F.substring(text, lack + 1, F.length(text) - 2 * lack), F.lit("}"))
    each = whole.groupBy("slide", "feature").agg(F.sort_array(F.collect_list(F.struct("member", one.alias("g")))).alias("gs"))
    joined = F.array_join(F.transform("gs", lambda g: g["g"]), ",")
    geometry = F.when(F.get("gs", F.lit(0))["member"] < 0, joined).otherwise(F.concat(F.lit('{"type":"GeometryCollection","geometries":['), joined, F.lit("]}")))
    f = docs.select("slide", F.from_json("geojson", FEATURES).alias("g")).select("slide", F.posexplode("g.features").alias("feature", "f"))
    f = f.select("slide", "feature", F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"))
    return each.select("slide", "feature", geometry.alias("geometry")).join(f, ["slide", "feature"]).select("slide", "feature", "geometry", "properties")


def warp_geojson(docs: DataFrame, transforms: DataFrame, forward: DataFrame | None = None, cell: float = 1.0) -> DataFrame:
    """(slide, feature, geometry, properties): features of collections in the registered frame, see ``warp_xy``."""
    return warp_geometries(docs, lambda v: warp_xy(v, transforms, forward, cell))


def collections(features: DataFrame) -> DataFrame:
    """(slide, geojson): feature collections of features as ``warp_geometries`` gives them."""
    f = F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"), F.lit(',"properties":'), F.coalesce(F.to_json("properties"), F.lit("{}")), F.lit("}"))
    all_ = features.groupBy("slide").agg(F.sort_array(F.collect_list(F.struct("feature", f.alias("f")))).alias("fs"))
    return all_.select("slide", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("]}")).alias("geojson"))

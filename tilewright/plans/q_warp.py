"""Queries: affine algebra, warping of points, polygons, annotations and rasters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.operators import fields as D
from tilewright.operators import tiles as T
from tilewright.operators import warp as W
from tilewright.plans import views as V
from tilewright.plans.registry import ORACLE_SQL, QUERIES, Query, query

R = lambda c, n=6: F.round(F.col(c), n).alias(c)
INV = "((a*(x-tx) + b*(y-ty)) / (a*a+b*b))", "((-b*(x-tx) + a*(y-ty)) / (a*a+b*b))"


@query(V.with_views("transforms points", f"SELECT slide, round(x, 6) AS x, round(y, 6) AS y, round({INV[0]}, 5) + 0.0 AS wx, round({INV[1]}, 5) + 0.0 AS wy FROM points JOIN transforms USING (slide)"))
def warp_points(spark: SparkSession, d: str) -> DataFrame:
    p = W.warp_points(V.points(spark, d), V.transforms(spark, d))
    return p.select("slide", R("x"), R("y"), (F.round("wx", 5) + 0.0).alias("wx"), (F.round("wy", 5) + 0.0).alias("wy"))


@query(V.with_views("transforms points", "SELECT slide, round(x, 6) AS x, round(y, 6) AS y, round(a*x - b*y + tx, 7) + 0.0 AS wx, round(b*x + a*y + ty, 7) + 0.0 AS wy FROM points JOIN transforms USING (slide)"))
def warp_points_inverse(spark: SparkSession, d: str) -> DataFrame:
    p = W.unwarp_points(V.points(spark, d), V.transforms(spark, d))
    return p.select("slide", R("x"), R("y"), (F.round("wx", 7) + 0.0).alias("wx"), (F.round("wy", 7) + 0.0).alias("wy"))


@query(
    V.with_views(
        "transforms points",
        f"""AND reg AS (SELECT slide, x, y, {INV[0]} AS rx, {INV[1]} AS ry, CASE WHEN slide % 7 + 1 = slide THEN 7 - slide + 1 ELSE slide % 7 + 1 END AS to_slide FROM points JOIN transforms USING (slide))
SELECT r.slide, round(x, 6) AS x, round(y, 6) AS y, to_slide, round(t.a*rx - t.b*ry + t.tx, 5) + 0.0 AS wx, round(t.b*rx + t.a*ry + t.ty, 5) + 0.0 AS wy FROM reg r JOIN transforms t ON t.slide = r.to_slide""",
    )
)
def warp_points_between_slides(spark: SparkSession, d: str) -> DataFrame:
    to = F.expr("case when slide % 7 + 1 = slide then 7 - slide + 1 else slide % 7 + 1 end")
    p = W.warp_between(V.points(spark, d), V.transforms(spark, d), to)
    return p.select("slide", R("x"), R("y"), "to_slide", (F.round("wx", 5) + 0.0).alias("wx"), (F.round("wy", 5) + 0.0).alias("wy"))


@query(V.with_views("transforms points", f"AND s AS (SELECT slide, x AS x0, y AS y0, x / 4.0 AS x, y / 4.0 AS y FROM points) SELECT slide, round(x0, 6) AS x, round(y0, 6) AS y, round({INV[0]} * 2.0, 5) + 0.0 AS wx, round({INV[1]} * 2.0, 5) + 0.0 AS wy FROM s JOIN transforms USING (slide)"))
def warp_points_at_level(spark: SparkSession, d: str) -> DataFrame:
    p = W.warp_scaled(V.points(spark, d), V.transforms(spark, d), 4.0, 2.0)
    return p.select("slide", R("x"), R("y"), (F.round("wx", 5) + 0.0).alias("wx"), (F.round("wy", 5) + 0.0).alias("wy"))


FIELD = "field AS (SELECT slide, gx::INT AS gx, gy::INT AS gy, sin(gx * 0.3 + slide) * 4 AS dx, cos(gy * 0.2) * 3 AS dy FROM (SELECT slide, unnest(range(0, 11)) AS gx FROM transforms), (SELECT unnest(range(0, 11)) AS gy))"


def field(spark: SparkSession, d: str) -> DataFrame:
    """A displacement field on a grid of 11 x 11 values for each slide."""
    g = V.transforms(spark, d).selectExpr("slide", "explode(sequence(0, 10)) as gx").selectExpr("slide", "gx", "explode(sequence(0, 10)) as gy")
    return g.selectExpr("slide", "gx", "gy", "sin(gx * 0.3D + slide) * 4 as dx", "cos(gy * 0.2D) * 3 as dy")


@query(
    V.with_views(
        "transforms points",
        "AND " + FIELD + """, p AS (SELECT slide, x, y, floor(x / 100)::INT AS gx, floor(y / 100)::INT AS gy, x / 100 - floor(x / 100)::INT AS fx, y / 100 - floor(y / 100)::INT AS fy FROM points)
SELECT p.slide, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.x + coalesce((a.dx*(1-fx) + b.dx*fx)*(1-fy) + (c.dx*(1-fx) + e.dx*fx)*fy, 0), 5) AS wx, round(p.y + coalesce((a.dy*(1-fx) + b.dy*fx)*(1-fy) + (c.dy*(1-fx) + e.dy*fx)*fy, 0), 5) AS wy
FROM p LEFT JOIN field a ON a.slide = p.slide AND a.gx = p.gx AND a.gy = p.gy LEFT JOIN field b ON b.slide = p.slide AND b.gx = p.gx + 1 AND b.gy = p.gy
LEFT JOIN field c ON c.slide = p.slide AND c.gx = p.gx AND c.gy = p.gy + 1 LEFT JOIN field e ON e.slide = p.slide AND e.gx = p.gx + 1 AND e.gy = p.gy + 1""",
    )
)
def warp_points_non_rigid(spark: SparkSession, d: str) -> DataFrame:
    return W.displace(V.points(spark, d), field(spark, d), 100.0).select("slide", R("x"), R("y"), R("wx", 5), R("wy", 5))


@query(V.with_views("transforms", "SELECT slide, round(tx, 6) AS tx, round(ty, 6) AS ty, round(atan2(b, a), 6) AS rotation, round(sqrt(a*a+b*b), 6) AS scale_x, round(sqrt(a*a+b*b), 6) AS scale_y, round(atan2(b, a) - atan2(b, a), 6) + 0.0 AS shear FROM transforms"))
def affine_decompose(spark: SparkSession, d: str, transforms: Query = V.transforms) -> DataFrame:
    p = transforms(spark, d).select("slide", A.decompose(F.col("m")).alias("p")).select("slide", "p.*")
    return p.select("slide", *[(F.round(c, 6) + 0.0).alias(c) for c in ("tx", "ty", "rotation", "scale_x", "scale_y", "shear")])


@query(V.with_views("transforms", "SELECT slide, round(a, 6) AS m00, round(-b * 2.0 / 3.0, 6) + 0.0 AS m01, round(tx * 2.0, 6) AS m02, round(b * 3.0 / 2.0, 6) AS m10, round(a, 6) AS m11, round(ty * 3.0, 6) AS m12 FROM transforms"))
def affine_scaled(spark: SparkSession, d: str, transforms: Query = V.transforms) -> DataFrame:
    m = transforms(spark, d).select("slide", A.scaled(F.col("m"), F.lit(2.0), F.lit(3.0)).alias("m"))
    return m.select("slide", *[(F.round(F.get("m", F.lit(3 * r + c)), 6) + 0.0).alias(f"m{r}{c}") for r in (0, 1) for c in (0, 1, 2)])


@query(V.with_views("transforms", "SELECT slide, round(a / (a*a+b*b), 6) AS m00, round(b / (a*a+b*b), 6) AS m01, round(-(a*tx + b*ty) / (a*a+b*b), 6) AS m02, round(-b / (a*a+b*b), 6) + 0.0 AS m10, round(a / (a*a+b*b), 6) AS m11, round((b*tx - a*ty) / (a*a+b*b), 6) AS m12 FROM transforms"))
def affine_inverse(spark: SparkSession, d: str, transforms: Query = V.transforms) -> DataFrame:
    m = transforms(spark, d).select("slide", A.inverse(F.col("m")).alias("m"))
    return m.select("slide", *[(F.round(F.get("m", F.lit(3 * r + c)), 6) + 0.0).alias(f"m{r}{c}") for r in (0, 1) for c in (0, 1, 2)])


@query(
    V.with_views(
        "slide_levels",
        """SELECT slide, level, -(w + 20 - w) / 2.0::DOUBLE AS pad_x, -(h + 31 - h) / 2.0::DOUBLE AS pad_y, round(w / (w * 2.0::DOUBLE), 6) AS resize_x, (w - 1)::DOUBLE AS mirror_x,
  round((w/2.0 - 0.5) - cos(0.3::DOUBLE)*(w/2.0 - 0.5) + sin(0.3::DOUBLE)*(h/2.0 - 0.5), 5) AS turn_x FROM slide_levels""",
    )
)
def affine_builders(spark: SparkSession, d: str) -> DataFrame:
    """Padding, resizing, mirroring and turning matrices of images."""
    w, h = F.col("w"), F.col("h")
    at = lambda m, k: F.get(m, F.lit(k))
    return V.slide_levels(spark, d).select(
        "slide",
        "level",
        at(A.padding(w, h, w + 20, h + 31), 2).alias("pad_x"),
        at(A.padding(w, h, w + 20, h + 31), 5).alias("pad_y"),
        F.round(at(A.resize(w, h, w * 2, h * 2), 0), 6).alias("resize_x"),
        at(A.reflection(F.lit(True), F.lit(False), w, h), 2).alias("mirror_x"),
        F.round(at(A.rotation_about_centre(F.lit(0.3), w, h), 2), 5).alias("turn_x"),
    )


def _levels_with_transforms(spark: SparkSession, d: str, transforms: Query) -> DataFrame:
    """Levels of slides with the slides' matrices. There may be as many matrices as slides, so neither side is broadcast."""
    return V.slide_levels(spark, d).join(transforms(spark, d).select("slide", "m").hint("merge"), "slide")


@query(V.with_views("transforms slide_levels", "SELECT slide, level, round((w::DOUBLE * h) / (a*a+b*b), 3) AS area FROM slide_levels JOIN transforms USING (slide)"))
def warped_area(spark: SparkSession, d: str, transforms: Query = V.transforms) -> DataFrame:
    """Area of a slide's outline in the registered frame."""
    s = _levels_with_transforms(spark, d, transforms)
    area = A.polygon_area(A.let(A.inverse(F.col("m")), lambda inv: F.transform(A.corners(F.col("w"), F.col("h")), lambda p: A.apply_xy(inv, p["x"], p["y"]))))
    return s.select("slide", "level", F.round(area, 3).alias("area"))


@query(
    V.with_views(
        "transforms slide_levels",
        f"""AND c AS (SELECT slide, level, a, b, tx, ty, unnest([0, w, w, 0])::DOUBLE AS x, unnest([0, 0, h, h])::DOUBLE AS y FROM slide_levels JOIN transforms USING (slide)),
q AS (SELECT slide, level, {INV[0]} AS px, {INV[1]} AS py FROM c)
SELECT slide, level, ceil(round(greatest(max(px), 0) - least(min(px), 0), 6))::BIGINT AS out_w, ceil(round(greatest(max(py), 0) - least(min(py), 0), 6))::BIGINT AS out_h FROM q GROUP BY slide, level""",
    )
)
def warped_canvas(spark: SparkSession, d: str, transforms: Query = V.transforms) -> DataFrame:
    """The frames that the slides' levels need."""
    s = _levels_with_transforms(spark, d, transforms)
    return W.warped_canvas(s, ("slide", "level"))


@query(
    V.with_views(
        "transforms",
        f"""AND rings AS (SELECT slide, a, b, tx, ty, k, unnest([0, 10, 10, 0, 0])::DOUBLE + 5 * k AS x, unnest([0, 0, 8, 8, 0])::DOUBLE + slide AS y, unnest(range(0, 5)) AS o FROM transforms, (SELECT unnest(range(0, 3)) AS k)),
w AS (SELECT slide, k, o, round({INV[0]}, 3) + 0.0 AS px, round({INV[1]}, 3) + 0.0 AS py FROM rings)
SELECT slide, k::INT AS feature, o::INT AS vertex, px, py, 'roi ' || k AS label FROM w""",
    )
)
def warp_geojson(spark: SparkSession, d: str, transforms: Query = V.transforms) -> DataFrame:
    t = transforms(spark, d)
    xs, ys = (0, 10, 10, 0, 0), (0, 0, 8, 8, 0)
    ring = F.array(*[F.array(F.lit(float(x)) + 5 * F.col("k"), F.lit(float(y)) + F.col("slide")) for x, y in zip(xs, ys, strict=True)])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.create_map(F.lit("label"), F.concat(F.lit("roi "), F.col("k").cast("string"))).alias("properties"))
    docs = t.select("slide", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("f", feature).groupBy("slide").agg(F.sort_array(F.collect_list(F.struct("k", F.to_json("f").alias("j")))).alias("fs"))
    docs = docs.select("slide", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs.j", ","), F.lit("]}")).alias("geojson"))
    w = W.warp_geojson(docs, t)
    p = w.select("slide", "feature", F.posexplode(F.get(F.from_json("geometry", "type string, coordinates array<array<array<double>>>")["coordinates"], F.lit(0))).alias("vertex", "v"), F.col("properties")["label"].alias("label"))
    return p.select("slide", "feature", "vertex", (F.get("v", F.lit(0)) + 0.0).alias("px"), (F.get("v", F.lit(1)) + 0.0).alias("py"), "label")


@query(
    V.with_views(
        "points",
        "SELECT slide, count(*) AS n, (count(*) FILTER (WHERE x >= 100 AND x < 400 AND y >= 200 AND y < 700))::BIGINT AS in_box, (count(*) FILTER (WHERE x + y / 2 < 450 AND x > 50 AND y > 100.5))::BIGINT AS in_triangle FROM points GROUP BY slide",
    )
)
def points_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """Points in a half-open box, and strictly inside a polygon."""
    tri = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((50, 100.5), (399.75, 100.5), (50, 800))])
    x, y = F.col("x"), F.col("y")
    box = (x >= 100) & (x < 400) & (y >= 200) & (y < 700)
    return V.points(spark, d).groupBy("slide").agg(F.count(F.lit(1)).alias("n"), F.count_if(box).alias("in_box"), F.count_if(A.point_in_polygon(x, y, tri)).alias("in_triangle"))


@query(
    V.with_views(
        "points",
        """SELECT slide, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x) - min(x), 6) AS w, round(max(y) - min(y), 6) AS h, round(max(least(greatest(x, 0), 300)), 6) AS clipped_x,
  round(greatest(min(x) - 10, 0), 6) AS grown_x, round(least(max(x) - min(x) + 20, 1000 - greatest(min(x) - 10, 0)), 6) AS grown_w FROM points GROUP BY slide""",
    )
)
def point_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounding boxes of points, clipped, and grown by a margin within an image 1000 wide."""
    p = V.points(spark, d).withColumn("c", T.clipped(F.col("x"), F.col("y"), F.lit(300.0), F.lit(300.0)))
    b = p.groupBy("slide").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.max("c.x").alias("clipped_x"))
    b = b.withColumn("g", T.expanded_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(10), F.lit(1000), F.lit(1000)))
    return b.select("slide", R("x"), R("y"), R("w"), R("h"), R("clipped_x"), F.round("g.x", 6).alias("grown_x"), F.round("g.w", 6).alias("grown_w"))


@query(V.with_views("transforms", "AND " + FIELD + " SELECT slide, gx * 2 + ox AS gx, gy * 2 + oy AS gy, round(dx * 2, 6) AS dx, round(dy * 2, 6) AS dy FROM field, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(ox, oy)"))
def field_resized(spark: SparkSession, d: str) -> DataFrame:
    """A displacement field at twice the size: nearest values, with vectors scaled alike."""
    return D.scale(field(spark, d), 2, 2).select("slide", "gx", "gy", R("dx"), R("dy"))


@query(V.with_views("transforms", "AND " + FIELD + " SELECT t.slide, x::INT AS gx, y::INT AS gy, round(coalesce(dx, 0), 6) AS dx, round(coalesce(dy, 0), 6) AS dy FROM transforms t, (SELECT unnest(range(0, 16)) AS x), (SELECT unnest(range(0, 14)) AS y) LEFT JOIN field f ON f.slide = t.slide AND f.gx = x - 3 AND f.gy = y - 2"))
def field_padded(spark: SparkSession, d: str) -> DataFrame:
    """A field of a part of the frame in the whole frame, with zeros around."""
    frame = V.transforms(spark, d).select("slide", F.lit(16).alias("w"), F.lit(14).alias("h"), F.lit(3).alias("x"), F.lit(2).alias("y"))
    return D.pad(field(spark, d), frame).select("slide", "gx", "gy", R("dx"), R("dy"))


@query(V.with_views("transforms", "AND " + FIELD + " SELECT slide, round(avg(sqrt(dx*dx+dy*dy)), 6) AS mean_length, round(max(sqrt(dx*dx+dy*dy)), 6) AS max_length FROM field GROUP BY slide"))
def field_magnitude(spark: SparkSession, d: str) -> DataFrame:
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return field(spark, d).groupBy("slide").agg(F.round(F.avg(length), 6).alias("mean_length"), F.round(F.max(length), 6).alias("max_length"))


@query(
    V.with_views(
        "transforms slide_levels",
        """SELECT slide, level, CASE slide % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'overlap' ELSE 'all' END AS crop, CASE slide % 3 WHEN 0 THEN 0 WHEN 1 THEN floor(w * 0.1)::INT ELSE 0 END AS x,
  CASE slide % 3 WHEN 0 THEN w WHEN 1 THEN ceil(w * 0.8)::INT ELSE ceil(w * 1.25)::INT END AS w, CASE slide % 3 WHEN 0 THEN h WHEN 1 THEN ceil(h * 0.8)::INT ELSE ceil(h * 1.25)::INT END AS h FROM slide_levels""",
    )
)
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The part of a slide's frame that its crop policy keeps."""
    kind = F.expr("case slide % 3 when 0 then 'reference' when 1 then 'overlap' else 'all' end")
    s = V.slide_levels(spark, d).withColumn("crop", kind).withColumn("b", T.crop_box(F.col("crop"), F.col("w"), F.col("h")))
    return s.select("slide", "level", "crop", "b.x", "b.w", "b.h")


@query(
    V.with_views(
        "pixels",
        """AND img AS (SELECT image, max(x) AS w, max(y) AS h FROM pixels GROUP BY image), o AS (SELECT image, unnest(range(0, w + 1))::INT AS x, h FROM img), q AS (SELECT image, x, unnest(range(0, h + 1))::INT AS y FROM o),
g AS (SELECT image, x, y, floor(cos(0.1::DOUBLE)*x - sin(0.1::DOUBLE)*y + 1.5 + 0.5)::INT AS sx, floor(sin(0.1::DOUBLE)*x + cos(0.1::DOUBLE)*y - 0.75 + 0.5)::INT AS sy FROM q)
SELECT g.image, g.x, g.y, coalesce(p.v1, 0) AS v1, coalesce(p.v2, 0) AS v2 FROM g LEFT JOIN pixels p ON p.image = g.image AND p.x = g.sx AND p.y = g.sy""",
    )
)
def warp_raster_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Whole images, in frames of their own size."""
    return W.warp_raster_nearest(V.pixels(spark, d), A.similarity(F.lit(0.1), F.lit(1.0), F.lit(1.5), F.lit(-0.75)), None, None, ["v1", "v2"])


# The same over the transforms of all slides.
for _f in (affine_decompose, affine_scaled, affine_inverse, warped_area, warped_canvas, warp_geojson):
    QUERIES[f"{_f.__name__}_all"] = functools.partial(_f, transforms=V.all_transforms)
    ORACLE_SQL[f"{_f.__name__}_all"] = ORACLE_SQL[_f.__name__].replace(V.SQL["transforms"], V.SQL["all_transforms"])

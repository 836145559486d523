"""Queries: points and images through whole transforms, grids, refinement and errors of a stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.operators import estimate as E
from tilewright.operators import fields as D
from tilewright.operators import grouped as G
from tilewright.operators import matching as M
from tilewright.operators import raster as P
from tilewright.operators import register as N
from tilewright.operators import resample as RS
from tilewright.operators import tiles as T
from tilewright.operators import warp as W
from tilewright.plans import q_matching, q_warp
from tilewright.plans import views as V
from tilewright.plans.q_matching import FIT
from tilewright.plans.registrar import Registrar
from tilewright.plans.registry import query
from tilewright.session import table
from tilewright.sources import images as SI

R = lambda c, n=6: (F.round(F.col(c), n) + 0.0).alias(c)
INV = ("((a*({x}-tx) + b*({y}-ty)) / (a*a+b*b))", "((-b*({x}-tx) + a*({y}-ty)) / (a*a+b*b))")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    size = {"fit_w": 500, "fit_h": 400, "pt_w": 2000, "pt_h": 1200, "reg_w": 600, "reg_h": 500, "field_w": 1200, "field_h": 1500, "out_w": 2400, "out_h": 1000}
    return V.transforms(spark, d).select("slide", "m", *[F.lit(v).alias(k) for k, v in size.items()])


@query(V.with_views("transforms", "SELECT slide, 4.0::DOUBLE AS src_sx, 3.0::DOUBLE AS src_sy, 2.0::DOUBLE AS field_sx, 3.0::DOUBLE AS field_sy, 2.0::DOUBLE AS dst_sx, round(1000 / 1500.0::DOUBLE, 9) AS dst_sy FROM transforms"))
def scaling_factors(spark: SparkSession, d: str) -> DataFrame:
    """Factors between the sizes of points, fit, registered image, field and output."""
    names = ["src_sx", "src_sy", "field_sx", "field_sy", "dst_sx", "dst_sy"]
    return W.scaling_factors(_sized(spark, d)).select("slide", *[F.round(c, 9).alias(c) for c in names])


FIELD_AT = """at_ AS (SELECT p.*, floor(px / 100)::INT AS gx, floor(py / 100)::INT AS gy, px / 100 - floor(px / 100)::INT AS fx, py / 100 - floor(py / 100)::INT AS fy FROM placed p),
moved AS (SELECT p.*, px + coalesce((a.dx*(1-fx) + b.dx*fx)*(1-fy) + (c.dx*(1-fx) + e.dx*fx)*fy, 0) AS mx, py + coalesce((a.dy*(1-fx) + b.dy*fx)*(1-fy) + (c.dy*(1-fx) + e.dy*fx)*fy, 0) AS my
  FROM at_ p LEFT JOIN field a ON a.slide = p.slide AND a.gx = p.gx AND a.gy = p.gy LEFT JOIN field b ON b.slide = p.slide AND b.gx = p.gx + 1 AND b.gy = p.gy
  LEFT JOIN field c ON c.slide = p.slide AND c.gx = p.gx AND c.gy = p.gy + 1 LEFT JOIN field e ON e.slide = p.slide AND e.gx = p.gx + 1 AND e.gy = p.gy + 1)"""


@query(
    V.with_views(
        "transforms points",
        f"AND {q_warp.FIELD}, placed AS (SELECT slide, x, y, {INV[0].format(x='x / 4.0', y='y / 3.0')} * 2 AS px, {INV[1].format(x='x / 4.0', y='y / 3.0')} * 3 AS py FROM points JOIN transforms USING (slide)), {FIELD_AT}"
        " SELECT slide, round(x, 6) AS x, round(y, 6) AS y, round(mx * 2, 4) + 0.0 AS wx, round(my * 1000 / 1500, 4) + 0.0 AS wy FROM moved",
    )
)
def warp_points_full(spark: SparkSession, d: str) -> DataFrame:
    """Points under scale, matrix, scale, field and scale."""
    w = W.warp_xy(V.points(spark, d), _sized(spark, d), q_warp.field(spark, d), 100.0)
    return w.select("slide", R("x"), R("y"), R("wx", 4), R("wy", 4))


@query(
    V.with_views(
        "transforms points",
        f"AND {q_warp.FIELD}, placed AS (SELECT slide, x, y, x / 2 AS px, y * 1500 / 1000 AS py FROM points), {FIELD_AT}"
        ", back AS (SELECT m.slide, m.x, m.y, a * (mx / 2) - b * (my / 3) + tx AS sx, b * (mx / 2) + a * (my / 3) + ty AS sy FROM moved m JOIN transforms USING (slide))"
        " SELECT slide, round(x, 6) AS x, round(y, 6) AS y, round(sx * 4, 4) + 0.0 AS wx, round(sy * 3, 4) + 0.0 AS wy FROM back",
    )
)
def unwarp_points_full(spark: SparkSession, d: str) -> DataFrame:
    """The way back: scale, field, scale, matrix and scale."""
    w = W.unwarp_xy(V.points(spark, d), _sized(spark, d), q_warp.field(spark, d), 100.0)
    return w.select("slide", R("x"), R("y"), R("wx", 4), R("wy", 4))


@query()
def warp_points_between_fields(spark: SparkSession, d: str) -> DataFrame:
    """Points of a slide on another one, with both slides' fields."""
    f = q_warp.field(spark, d)
    return W.warp_xy_between(V.points(spark, d), _sized(spark, d).drop("field_w", "field_h"), (F.col("slide") % 7 + 1).cast("int"), f, f, 100.0)


@query()
def warp_points_bicubic(spark: SparkSession, d: str) -> DataFrame:
    return W.displace(V.points(spark, d), q_warp.field(spark, d), 100.0, order=3)


@query(V.with_views("transforms", "AND f AS (SELECT slide, a, b, tx, ty, unnest(range(0, 9))::INT AS x FROM transforms), g AS (SELECT *, unnest(range(0, 7))::INT AS y FROM f) SELECT slide, x, y, round(a*x - b*y + tx, 6) + 0.0 AS sx, round(b*x + a*y + ty, 6) + 0.0 AS sy FROM g"))
def warp_map(spark: SparkSession, d: str) -> DataFrame:
    """The place in the source of each pixel of a frame."""
    frame = V.transforms(spark, d).select("slide", "m", F.lit(9).alias("w"), F.lit(7).alias("h"))
    return W.warp_map(frame).select("slide", "x", "y", R("sx"), R("sy"))


@query(
    V.with_views(
        "transforms",
        f"""AND c AS (SELECT slide, a, b, tx, ty, unnest([0, 640, 640, 0])::DOUBLE AS x, unnest([0, 0, 480, 480])::DOUBLE AS y FROM transforms), w AS (SELECT *, {INV[0].format(x='x', y='y')} * 2 AS px, {INV[1].format(x='x', y='y')} * 3 AS py FROM c),
u AS (SELECT slide, a * px - b * 2 / 3.0::DOUBLE * py + tx * 2 AS ux, b * 3 / 2.0::DOUBLE * px + a * py + ty * 3 AS uy FROM w) SELECT slide, round(round(max(ux), 6))::INT AS src_w, round(round(max(uy), 6))::INT AS src_h FROM u GROUP BY slide""",
    )
)
def source_frames(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of images that land in a larger frame as smaller ones do in theirs."""
    size = {"fit_w": 640, "fit_h": 480, "reg_w": 800, "reg_h": 700, "dst_w": 1600, "dst_h": 2100}
    s = V.transforms(spark, d).select("slide", "m", *[F.lit(v).alias(k) for k, v in size.items()])
    return W.source_frame(s).select("slide", "src_w", "src_h")


BILINEAR = """img AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image), o AS (SELECT image, w, h, unnest(range(0, w))::INT AS x FROM img), q AS (SELECT image, w, h, x, unnest(range(0, h))::INT AS y FROM o),
g AS (SELECT *, cos(0.1::DOUBLE)*x - sin(0.1::DOUBLE)*y + 1.5 AS sx, sin(0.1::DOUBLE)*x + cos(0.1::DOUBLE)*y - 0.75 AS sy FROM q), i AS (SELECT *, sx >= 0 AND sy >= 0 AND sx <= w - 1 AND sy <= h - 1 AS inside, floor(sx)::INT AS x0, floor(sy)::INT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM g)"""


def _rotation(spark: SparkSession, d: str) -> DataFrame:
    return V.pixels(spark, d).groupBy(F.col("image").alias("slide")).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).withColumn("m", A.similarity(F.lit(0.1), F.lit(1.0), F.lit(1.5), F.lit(-0.75)))


@query(
    V.with_views(
        "pixels",
        "AND " + BILINEAR + """ SELECT i.image, i.x, i.y, round(CASE WHEN inside THEN (coalesce(a.v1, 0)*(1-fx) + coalesce(b.v1, 0)*fx)*(1-fy) + (coalesce(c.v1, 0)*(1-fx) + coalesce(e.v1, 0)*fx)*fy ELSE 0 END, 6) + 0.0 AS v
FROM i LEFT JOIN pixels a ON a.image = i.image AND a.x = x0 AND a.y = y0 LEFT JOIN pixels b ON b.image = i.image AND b.x = least(x0 + 1, w - 1) AND b.y = y0 LEFT JOIN pixels c ON c.image = i.image AND c.x = x0 AND c.y = least(y0 + 1, h - 1)
LEFT JOIN pixels e ON e.image = i.image AND e.x = least(x0 + 1, w - 1) AND e.y = least(y0 + 1, h - 1)""",
    )
)
def warp_images_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Whole images under a matrix, tile by tile, bilinear."""
    t = RS.pack(V.pixels(spark, d), ["v1"], "float64", 64)
    out = RS.resample(_rotation(spark, d), [("matrix", "m")], t, None, 1, "float64", "bilinear", 0.0, 48, 64)
    return RS.unpack(out, ["v"]).select("image", "x", "y", R("v"))


@query()
def warp_images_field(spark: SparkSession, d: str) -> DataFrame:
    """Whole images under a field and a matrix, bicubic, as whole numbers."""
    p = V.pixels(spark, d)
    f = p.selectExpr("image as slide", "x as gx", "y as gy", "sin(x * 0.2D) * 2 as dx", "cos(y * 0.1D) as dy")
    return RS.unpack(RS.warp_images(RS.pack(p, ["v1", "v2"], "uint8"), _rotation(spark, d), f, 2, "uint8"), ["v1", "v2"], kind="int")


@query()
def warp_images_between(spark: SparkSession, d: str) -> DataFrame:
    """Images of each slide on the next one, nearest."""
    s = _rotation(spark, d)
    pairs = s.select(F.col("slide").alias("from_slide"), ((F.col("slide") + 1) % 10).alias("to_slide"), "w", "h").join(s.select(F.col("slide").alias("to_slide")), "to_slide", "left_semi")
    return RS.unpack(RS.warp_between(RS.pack(V.pixels(spark, d), ["v1"], "uint8"), pairs, s.select("slide", "m")), ["v1"], kind="int")


@query(V.with_views("pixels", "AND f AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image), c AS (SELECT image, w, h, unnest(range(0, 2 * w))::INT AS x FROM f), d AS (SELECT image, w, h, x, unnest(range(0, (h + 1) // 2))::INT AS y FROM c) SELECT d.image, d.x, d.y, p.v1 FROM d JOIN pixels p ON p.image = d.image AND p.x = least(floor((d.x + 0.5) * w / (2 * w)), w - 1)::INT AND p.y = least(floor((d.y + 0.5) * h / ((h + 1) // 2)), h - 1)::INT"))
def images_resized(spark: SparkSession, d: str) -> DataFrame:
    """Images twice as wide and half as high, nearest."""
    p = V.pixels(spark, d)
    s = p.groupBy("image").agg((F.max("x") + 1).alias("in_w"), (F.max("y") + 1).alias("in_h")).select("*", (F.col("in_w") * 2).alias("w"), F.expr("cast((in_h + 1) div 2 as int)").alias("h"))
    return P.resized_nearest(p, s, ["v1"])


@query(V.with_views("pixels", "AND f AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image), c AS (SELECT image, h, unnest(range(0, w + 5))::INT AS x FROM f), d AS (SELECT image, x, unnest(range(0, h + 8))::INT AS y FROM c) SELECT d.image, d.x, d.y, coalesce(p.v1, 7)::INT AS v1 FROM d LEFT JOIN pixels p ON p.image = d.image AND p.x = d.x - 2 AND p.y = d.y - 4"))
def images_padded(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    f = p.groupBy("image").agg((F.max("x") + 1).alias("in_w"), (F.max("y") + 1).alias("in_h")).select("*", (F.col("in_w") + 5).alias("w"), (F.col("in_h") + 8).alias("h"))
    return P.padded(p, f, ["v1"], 7).select("image", "x", "y", F.col("v1").cast("int").alias("v1"))


@query(V.with_views("pixels", "AND a AS (SELECT image, (x // 2)::INT AS x, (y // 2)::INT AS y, avg(v1) AS v FROM pixels GROUP BY ALL), b AS (SELECT image, (x // 2)::INT AS x, (y // 2)::INT AS y, avg(v) AS v FROM a GROUP BY ALL) SELECT image, 0 AS level, x, y, v1::DOUBLE AS v1 FROM pixels UNION ALL SELECT image, 1, x, y, round(v, 6) FROM a UNION ALL SELECT image, 2, x, y, round(v, 6) FROM b"))
def image_pyramid(spark: SparkSession, d: str) -> DataFrame:
    return P.pyramid(V.pixels(spark, d), ["v1"], 3).select("image", "level", "x", "y", R("v1"))


@query(V.with_views("slide_levels", "AND r AS (SELECT slide, level, w, h, unnest(range(0, (h - 1) // 500 + 1)) AS row FROM slide_levels), g AS (SELECT slide, level, w, h, row, unnest(range(0, (w - 1) // 500 + 1)) AS col FROM r) SELECT slide, level, row::INT AS row, col::INT AS col, (col * 500)::INT AS x, (row * 500)::INT AS y FROM g"))
def mesh(spark: SparkSession, d: str) -> DataFrame:
    """Points every 500 pixels of all levels of slides."""
    return T.mesh(V.slide_levels(spark, d), 500, keys=("slide", "level"))


@query(
    V.with_views(
        "slide_levels",
        """AND r AS (SELECT slide, level, w, h, unnest(range(0, (h - 1) // 500)) AS row FROM slide_levels), g AS (SELECT slide, level, row::INT AS row, unnest(range(0, (w - 1) // 500))::INT AS col FROM r),
t(side, ax, ay, bx, by_) AS (VALUES ('top', 0, 0, 1, 0), ('right', 1, 0, 1, 1), ('bottom', 1, 1, 0, 1), ('left', 0, 1, 0, 0))
SELECT slide, level, row, col, side, ((col + ax) * 500)::BIGINT AS ax, ((row + ay) * 500)::BIGINT AS ay, ((col + bx) * 500)::BIGINT AS bx, ((row + by_) * 500)::BIGINT AS by, (col * 500 + 250)::DOUBLE AS cx, (row * 500 + 250)::DOUBLE AS cy FROM g, t""",
    )
)
def mesh_triangles(spark: SparkSession, d: str) -> DataFrame:
    return T.triangles(mesh(spark, d), ("slide", "level"))


@query(V.with_views("slide_levels", "AND r AS (SELECT slide * 10 + level AS slide, w, h, unnest(range(0, greatest(h - 2, 0) // least(800, h) + 1)) AS ty FROM slide_levels), g AS (SELECT slide, w, h, ty, unnest(range(0, greatest(w - 2, 0) // least(800, w) + 1)) AS tx FROM r) SELECT slide, tx::INT AS tx, ty::INT AS ty, (10 + tx * least(800, w))::INT AS x, (20 + ty * least(800, h))::INT AS y, least(800, w - tx * least(800, w))::INT AS w, least(800, h - ty * least(800, h))::INT AS h FROM g"))
def roi_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of a region of each level of slides, which goes by ten times the slide and the level."""
    b = V.slide_levels(spark, d).select((F.col("slide") * 10 + F.col("level")).alias("slide"), F.lit(10).alias("x"), F.lit(20).alias("y"), "w", "h")
    return N.roi_tiles(b, 800).select("slide", "tx", "ty", "x", "y", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))


BOXES = "boxes AS (SELECT (p_partkey % 7)::INT AS slide, p_partkey::INT AS id, (p_partkey * 37 % 2000)::DOUBLE AS x, (p_partkey * 91 % 1500)::DOUBLE AS y, 10.0::DOUBLE + p_size AS w, 12.0::DOUBLE + p_size % 9 AS h FROM part)"


@query("WITH " + BOXES + " SELECT p.slide, p.id AS a, q.id AS b, round((least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * (least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)), 6) AS area FROM boxes p JOIN boxes q ON p.slide = q.slide AND p.id < q.id AND p.x < q.x + q.w AND q.x < p.x + p.w AND p.y < q.y + q.h AND q.y < p.y + p.h")
def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of polygons that overlap, and how much they share."""
    b = table(spark, d, "part").selectExpr("cast(p_partkey % 7 as int) as slide", "cast(p_partkey as int) as id", "cast(p_partkey * 37 % 2000 as double) as x", "cast(p_partkey * 91 % 1500 as double) as y", "10.0D + p_size as w", "12.0D + p_size % 9 as h")
    x, y, w, h = (F.col(c) for c in "xywh")
    corner = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
    polygons = b.select("slide", "id", F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h)).alias("corners"))
    return T.overlapping_polygons(polygons, 64).select("slide", "a", "b", R("area"))


@query(V.with_views("slide_levels", "SELECT slide, level, ceil(round(1000 * w / 800.0::DOUBLE, 9))::BIGINT AS aligned_w, ceil(round(900 * h / 600.0::DOUBLE, 9))::BIGINT AS aligned_h FROM slide_levels"))
def aligned_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The registered frame at each level."""
    s = V.slide_levels(spark, d).withColumn("a", T.aligned_size(F.lit(1000), F.lit(900), F.lit(800), F.lit(600), F.col("w"), F.col("h")))
    return s.select("slide", "level", F.col("a.w").alias("aligned_w"), F.col("a.h").alias("aligned_h"))


@query(V.with_views("slide_levels", "AND p AS (SELECT slide, coalesce(min(level) FILTER (WHERE greatest(w, h) <= 800), max(level)) AS level FROM slide_levels GROUP BY slide) SELECT slide, level, w, h, round(w::DOUBLE * h * 38 / 1073741824, 9) AS gb, w::DOUBLE * h * 38 / 1073741824 > 0.01 AS tiled FROM p JOIN slide_levels USING (slide, level)"))
def micro_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level that a refinement takes, its memory, and whether it goes by tiles."""
    return N.micro_level(V.slide_levels(spark, d), 800, 3, 1, 0.01).select("slide", "level", "w", "h", F.round("gb", 9).alias("gb"), "tiled")


@query(V.with_views("points", "AND b AS (SELECT DISTINCT slide, slide * 3 AS bx, slide % 11 AS by_ FROM points) SELECT slide, round(x + bx, 6) AS x, round(y + by_, 6) AS y FROM points JOIN b USING (slide)"))
def points_uncropped(spark: SparkSession, d: str) -> DataFrame:
    p = V.points(spark, d)
    b = p.select("slide").distinct().select("slide", (F.col("slide") * 3).alias("x"), (F.col("slide") % 11).alias("y"))
    return T.uncropped(p, b).select("slide", R("x"), R("y"))


@query(V.with_views("channels", "AND l AS (SELECT slide, list(name ORDER BY pos) AS names FROM channels GROUP BY slide), e AS (SELECT slide, names, unnest(range(1, len(names) + 1)) AS k FROM l) SELECT slide, (arg_min(k, (levenshtein(upper(names[k]), 'GREEM'), k)) - 1)::INT AS i FROM e GROUP BY slide"))
def channel_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The channel of which the name is nearest to the one asked for."""
    c = V.channels(spark, d).groupBy("slide").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return c.select("slide", SI.channel_index(F.col("l.name"), F.lit("greem")).cast("int").alias("i"))


@query("SELECT '/data/' || p_partkey || '.tif' AS path, CASE WHEN p_partkey % 6 = 0 THEN 'asked' WHEN p_partkey % 6 = 1 THEN 'named' ELSE 'tiff' END AS reader FROM part")
def reader_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Readers asked for by path or by name, or the one that the file calls for."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("/data/"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("path"))
    asked = p.where("p_partkey % 6 = 0").select("path", F.lit("asked").alias("reader")).unionByName(p.where("p_partkey % 6 = 1").select(F.col("p_partkey").cast("string").alias("path"), F.lit("named").alias("reader")))
    return SI.reader_table(p.select("path", F.lit("tiff").alias("reader")), asked)


@query(V.with_views("pixels", "AND h AS (SELECT image, v1, count(*) AS n FROM pixels GROUP BY ALL), s AS (SELECT *, lead(n) OVER w - n AS s FROM h WINDOW w AS (PARTITION BY image ORDER BY v1)), d AS (SELECT image, v1, abs(lead(s) OVER w - s) AS d FROM s WINDOW w AS (PARTITION BY image ORDER BY v1)) SELECT image, arg_min(v1, (d, v1)) AS v1 FROM d WHERE d IS NOT NULL GROUP BY image"))
def histogram_elbow(spark: SparkSession, d: str) -> DataFrame:
    h = V.pixels(spark, d).groupBy("image", "v1").agg(F.count(F.lit(1)).alias("n"))
    return P.elbow(h, "image", "v1", "n")


@query(
    V.with_views(
        "pixels",
        """AND t AS (SELECT image, least(floor((v1 - min(v1) OVER w)::DOUBLE / (max(v1) OVER w - min(v1) OVER w) * 32), 31) AS p, least(floor((v2 - min(v2) OVER w)::DOUBLE / (max(v2) OVER w - min(v2) OVER w) * 32), 31) AS q FROM pixels WINDOW w AS (PARTITION BY image)), n AS (SELECT image, count(*) AS n FROM t GROUP BY image),
a AS (SELECT image, sum(-k / n::DOUBLE * ln(k / n::DOUBLE)) AS h FROM (SELECT image, p, count(*) AS k FROM t GROUP BY ALL) JOIN n USING (image) GROUP BY image), b AS (SELECT image, sum(-k / n::DOUBLE * ln(k / n::DOUBLE)) AS h FROM (SELECT image, q, count(*) AS k FROM t GROUP BY ALL) JOIN n USING (image) GROUP BY image),
c AS (SELECT image, sum(-k / n::DOUBLE * ln(k / n::DOUBLE)) AS h FROM (SELECT image, p, q, count(*) AS k FROM t GROUP BY ALL) JOIN n USING (image) GROUP BY image) SELECT image, round(a.h + b.h - c.h, 6) AS mi FROM a JOIN b USING (image) JOIN c USING (image)""",
    )
)
def band_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return N.image_entropy(V.pixels(spark, d), "v1", "v2").select("image", R("mi"))


@query()
def matches_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of neighbouring images assigned to each other, each at most once."""
    kp = V.keypoints(spark, d)
    return M.assigned_pairs(kp, M.neighbour_pairs(kp), 0.0, 5.0, 0.01)


@query()
def matches_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Matches after a robust fit and then without outliers."""
    return E.filter_matches(q_matching.matched_points(spark, d).drop("d"), "ransac", 40.0)


@query(
    V.with_views(
        "keypoints",
        "AND " + FIT + """, two AS (SELECT image1, image2, i, j, x1, y1 FROM pts UNION ALL SELECT image2, image1, j, i, x2, y2 FROM pts), hit AS (SELECT image1, floor(x1 / 50) AS cx, floor(y1 / 50) AS cy FROM two GROUP BY ALL HAVING count(DISTINCT image2) > 1)
SELECT t.image1, t.image2, t.i, t.j FROM two t JOIN hit h ON h.image1 = t.image1 AND h.cx = floor(t.x1 / 50) AND h.cy = floor(t.y1 / 50)""",
    )
)
def matches_near_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Matches in cells of an image that matches to both its neighbours hit."""
    m = q_matching.matched_points(spark, d).drop("d")
    return M.cell_neighbours(M.both_ways(m), 50.0).select("image1", "image2", "i", "j")


@query()
def matches_neighbour_filtered(spark: SparkSession, d: str) -> DataFrame:
    """These matches, where their fit is no worse than that of all, or else all."""
    m = M.both_ways(q_matching.matched_points(spark, d).drop("d"))
    return M.better_subset(m, M.cell_neighbours(m, 50.0))


@query()
def matches_rematched(spark: SparkSession, d: str) -> DataFrame:
    """Matches joined with those of another metric, by which are more and nearer."""
    kp = V.keypoints(spark, d)
    new = M.with_points(M.match_pairs(kp, M.neighbour_pairs(kp), "manhattan"), kp)
    return E.rematch(q_matching.matched_points(spark, d), new, 40.0)


def _stack(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches towards the first image, transforms from it, and the order of a stack."""
    m = q_matching.matched_points(spark, d).drop("d")
    fits = M.fit_similarity(m).selectExpr("image2 as image", "array(a, -b, tx, b, a, ty, 0.0D, 0.0D, 1.0D) as m")
    turned = m.select(F.col("image2").alias("image1"), F.col("image1").alias("image2"), F.col("j").alias("i"), F.col("i").alias("j"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return turned, E.chain(fits), turned.select(F.col("image1").alias("image"), F.col("image2").alias("fixed")).distinct()


CHAIN = FIT + """, chain(image, a, b, tx, ty) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT f.image2, f.a * c.a - f.b * c.b, f.a * c.b + f.b * c.a, f.a * c.tx - f.b * c.ty + f.tx, f.b * c.tx + f.a * c.ty + f.ty FROM chain c JOIN fit f ON f.image1 = c.image),
reg AS (SELECT p.image2 AS image1, p.image1 AS image2, p.j AS i, p.i AS j, p.x1 AS ox, p.y1 AS oy, p.x2, p.y2, (t.a*(p.x2-t.tx) + t.b*(p.y2-t.ty)) / (t.a*t.a+t.b*t.b) AS ax, (-t.b*(p.x2-t.tx) + t.a*(p.y2-t.ty)) / (t.a*t.a+t.b*t.b) AS ay,
  (u.a*(p.x1-u.tx) + u.b*(p.y1-u.ty)) / (u.a*u.a+u.b*u.b) AS bx, (-u.b*(p.x1-u.tx) + u.a*(p.y1-u.ty)) / (u.a*u.a+u.b*u.b) AS by_ FROM pts p JOIN chain t ON t.image = p.image2 JOIN chain u ON u.image = p.image1)"""


def _chained(sql: str) -> str:
    return V.with_views("keypoints", "AND CHAINED").replace("WITH keypoints", "WITH RECURSIVE keypoints").replace("CHAINED", CHAIN + sql)


@query(_chained(" SELECT image1, image2, i, j, round(ax, 3) + 0.0 AS x1, round(ay, 3) + 0.0 AS y1, round(bx, 3) + 0.0 AS x2, round(by_, 3) + 0.0 AS y2 FROM reg"))
def matches_registered(spark: SparkSession, d: str) -> DataFrame:
    """Matched points of both images in the registered frame."""
    m, t, _ = _stack(spark, d)
    return N.registered_points(m, t).select("image1", "image2", "i", "j", R("x1", 3), R("y1", 3), R("x2", 3), R("y2", 3))


ERRORS = " , e AS (SELECT image1, image2, count(*) AS n, median(sqrt(pow(ox - x2, 2) + pow(oy - y2, 2))) AS o, median(sqrt(pow(ax - bx, 2) + pow(ay - by_, 2))) AS r FROM reg GROUP BY ALL)"


@query(_chained(ERRORS + " SELECT image1, image2, n, round(o * 0.5, 4) AS original_d, round(o / 724.0::DOUBLE, 5) AS original_rtre, round(r * 0.5, 4) AS rigid_d, round(r / 724.0::DOUBLE, 5) AS rigid_rtre FROM e"))
def stack_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each image against its neighbour, as it was and registered, in units of length."""
    m, t, _ = _stack(spark, d)
    return N.stack_errors(m, t, None, 724.0, 0.5).select("image1", "image2", "n", R("original_d", 4), R("original_rtre", 5), R("rigid_d", 4), R("rigid_rtre", 5))


@query(_chained(ERRORS + " SELECT round(sum(o * n) / sum(n), 4) AS mean_original_d, round(sum(r * n) / sum(n), 4) AS mean_rigid_d FROM e"))
def stack_mean_errors(spark: SparkSession, d: str) -> DataFrame:
    m, t, _ = _stack(spark, d)
    return N.mean_errors(N.stack_errors(m, t)).select(R("mean_original_d", 4), R("mean_rigid_d", 4))


@query()
def stack_settled(spark: SparkSession, d: str) -> DataFrame:
    """Transforms after what was left between neighbours is taken off."""
    m, t, order = _stack(spark, d)
    return E.settle(m, t, order)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    images = V.pixels(spark, d).select("image").distinct()
    p = images.select(F.col("image").alias("image1"), (F.col("image") - 1).alias("image2")).join(images.select(F.col("image").alias("image2")), "image2", "left_semi")
    return p.select("image1", "image2", A.identity().alias("m"))


@query()
def pairs_optimised(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of neighbouring images by their mutual information."""
    return N.optimise_pairs(V.pixels(spark, d), "v1", _pairs(spark, d), "nmi", 2)


@query()
def fields_to_reference(spark: SparkSession, d: str) -> DataFrame:
    return N.register_to_reference(V.pixels(spark, d), 5, "v1", lambda t: G.flow(t, "fixed", "moving", 64, 8))


@query()
def fields_serial(spark: SparkSession, d: str) -> DataFrame:
    steps = E.alignment_schedule(V.pixels(spark, d).select("image"))
    return N.register_serial(V.pixels(spark, d), steps, "v1", lambda t: G.flow(t, "fixed", "moving", 64, 8))


@query()
def fields_composed(spark: SparkSession, d: str) -> DataFrame:
    f = q_warp.field(spark, d)
    return D.compose(f, f)


@query()
def fields_without_invasive(spark: SparkSession, d: str) -> DataFrame:
    s = V.transforms(spark, d).select("slide", A.identity().alias("m"), F.lit(8).alias("src_w"), F.lit(9).alias("src_h"))
    return D.remove_invasive(q_warp.field(spark, d), s, 1)


@query()
def registered_stack(spark: SparkSession, d: str) -> DataFrame:
    """A whole stack: order by likeness, reference, robust matches, chained fits, refinement, errors."""
    return Registrar(V.keypoints(spark, d), ordered=False, threshold=40.0, settle=1).register().summary()

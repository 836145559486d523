"""Queries: colour, masks, components, histograms, normalisation, intensity measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import masks as Mk
from tilewright.operators import raster as P
from tilewright.operators import stain as S
from tilewright.plans import views as V
from tilewright.plans.registry import query

R = lambda c, n=6: F.round(F.col(c), n).alias(c)


LIMITS = "lim AS (SELECT image, min(v1) AS lo, max(v1) AS hi FROM pixels GROUP BY image)"


@query(V.with_views("pixels", "AND " + LIMITS + " SELECT image, x, y, floor(coalesce((v1 - lo) * 255.0::DOUBLE / nullif(hi - lo, 0), 0))::INT AS v, 255 - floor(coalesce((v1 - lo) * 255.0::DOUBLE / nullif(hi - lo, 0), 0))::INT AS inverted FROM pixels JOIN lim USING (image)"))
def channel_rescaled(spark: SparkSession, d: str) -> DataFrame:
    p = S.stretched(V.pixels(spark, d).select("image", "x", "y", F.col("v1").alias("v")), "v")
    return p.select("image", "x", "y", "v", (255 - F.col("v")).alias("inverted"))


OD_SQL = "od AS (SELECT image, x, y, (greatest(-log10(v1 / 255.0::DOUBLE + 2.220446049250313e-16), 0) + greatest(-log10(v2 / 255.0::DOUBLE + 2.220446049250313e-16), 0)) / 2 AS od FROM pixels)"


@query(V.with_views("pixels", "AND " + OD_SQL + ", p AS (SELECT image, quantile_cont(od, 0.95) AS p95 FROM od GROUP BY image) SELECT image, x, y, round(least(od, p95), 6) AS od FROM od JOIN p USING (image)"))
def optical_density(spark: SparkSession, d: str) -> DataFrame:
    """Mean optical density of the bands, cut at the 95th percentile of the image."""
    return S.optical_density(V.pixels(spark, d), ["v1", "v2"]).select("image", "x", "y", R("od"))


@query(
    V.with_views(
        "pixels",
        """AND s AS (SELECT image, x, y, (v1 - min(v1) OVER w)::DOUBLE / nullif(max(v1) OVER w - min(v1) OVER w, 0) AS j, (v2 - min(v2) OVER w)::DOUBLE / nullif(max(v2) OVER w - min(v2) OVER w, 0) AS c FROM pixels WINDOW w AS (PARTITION BY image)),
q AS (SELECT image, quantile_cont(j, 0.99) AS j0, quantile_cont(c, 0.01) AS c0 FROM s GROUP BY image) SELECT image, x, y, round(sqrt(pow(j - j0, 2) + pow(c - c0, 2)), 6) AS d FROM s JOIN q USING (image)""",
    )
)
def background_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of (lightness, colourfulness) from the background: their 99th and 1st percentile."""
    s = S.stretched(S.stretched(V.pixels(spark, d), "v1", 0, 1, whole=False), "v2", 0, 1, whole=False)
    q = s.groupBy("image").agg(F.percentile("v1", 0.99).alias("j0"), F.percentile("v2", 0.01).alias("c0"))
    dist = F.sqrt(F.pow(F.col("v1") - F.col("j0"), 2) + F.pow(F.col("v2") - F.col("c0"), 2))
    return s.join(q, "image").select("image", "x", "y", F.round(dist, 6).alias("d"))


@query(
    V.with_views(
        "pixels",
        """AND q AS (SELECT image, quantile_cont(v1, 0.9) AS t FROM pixels GROUP BY image), bg AS (SELECT image, avg(v1) AS m1, avg(v2) AS m2 FROM pixels JOIN q USING (image) WHERE v1 >= t GROUP BY image)
SELECT image, x, y, round(sqrt(pow(v1 - m1, 2) + pow(v2 - m2, 2)), 6) AS d FROM pixels JOIN bg USING (image)""",
    )
)
def bright_background_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance from the mean colour of the brightest tenth of the image."""
    p = V.pixels(spark, d)
    q = p.groupBy("image").agg(F.percentile("v1", 0.9).alias("t"))
    bg = p.join(q, "image").where("v1 >= t").groupBy("image").agg(F.avg("v1").alias("m1"), F.avg("v2").alias("m2"))
    dist = F.sqrt(F.pow(F.col("v1") - F.col("m1"), 2) + F.pow(F.col("v2") - F.col("m2"), 2))
    return p.join(bg, "image").select("image", "x", "y", F.round(dist, 6).alias("d"))


A_SQL, B_SQL = "(SELECT image, x, y FROM pixels WHERE v1 > 60)", "(SELECT image, x, y FROM pixels WHERE v2 > 100)"


def _masks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = V.pixels(spark, d)
    return p.where("v1 > 60").select("image", "x", "y"), p.where("v2 > 100").select("image", "x", "y")


@query(V.with_views("pixels", f"SELECT 'or' AS op, * FROM ({A_SQL} UNION {B_SQL}) UNION ALL SELECT 'and', * FROM ({A_SQL} INTERSECT {B_SQL})"))
def masks_combined(spark: SparkSession, d: str) -> DataFrame:
    a, b = _masks(spark, d)
    return P.combine_masks(a, b, "or").select(F.lit("or").alias("op"), "*").union(P.combine_masks(a, b, "and").select(F.lit("and").alias("op"), "*"))


COMP_SQL = """m AS ({mask}), reach(image, x, y, cx, cy) AS (
  SELECT image, x, y, x, y FROM m UNION SELECT r.image, n.x, n.y, r.cx, r.cy FROM reach r JOIN m n ON n.image = r.image AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1),
comp AS (SELECT image, x, y, min(cy::BIGINT * 4294967296 + cx) AS comp FROM reach GROUP BY image, x, y)"""


def _recursive(body: str) -> str:
    return V.with_views("pixels", "AND " + body).replace("WITH pixels", "WITH RECURSIVE pixels")


@query(_recursive(COMP_SQL.format(mask="SELECT image, x, y FROM pixels WHERE v1 > 60") + " SELECT image, x, y, comp FROM comp"))
def mask_components(spark: SparkSession, d: str) -> DataFrame:
    return P.components(_masks(spark, d)[0]).select("image", "x", "y", "comp")


@query(_recursive(COMP_SQL.format(mask="SELECT image, x, y FROM pixels WHERE v1 > 60") + ", a AS (SELECT image, comp, count(*) AS area FROM comp GROUP BY ALL) SELECT image, comp, area FROM a WHERE area >= 0.3 * (SELECT max(area) FROM a b WHERE b.image = a.image)"))
def mask_large_components(spark: SparkSession, d: str) -> DataFrame:
    return P.large_components(P.components(_masks(spark, d)[0]), 0.3).select("image", "comp", "area")


@query(_recursive(COMP_SQL.format(mask="SELECT image, x, y FROM pixels WHERE v1 > 60") + " SELECT image, comp, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM comp GROUP BY image, comp"))
def mask_component_boxes(spark: SparkSession, d: str) -> DataFrame:
    s = Mk.region_sizes(P.components(_masks(spark, d)[0]))
    return s.select("image", "comp", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))


@query(
    _recursive(
        COMP_SQL.format(mask="SELECT image, x, y FROM pixels WHERE v1 > 60 OR v2 > 130") + """, both_ AS (SELECT image, x, y FROM pixels WHERE v1 > 60 AND v2 > 130),
seeds AS (SELECT DISTINCT image, comp FROM comp JOIN both_ USING (image, x, y)) SELECT image, x, y, comp FROM comp JOIN seeds USING (image, comp)"""
    )
)
def mask_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    masks = p.where("v1 > 60").select("image", "x", "y").unionAll(p.where("v2 > 130").select("image", "x", "y"))
    return P.hysteresis(masks, 2).select("image", "x", "y", "comp")


@query(V.with_views("pixels", "AND q AS (SELECT image, quantile_cont(v1, 0.01) AS q1, quantile_cont(v2, 0.01) AS q2 FROM pixels GROUP BY image) SELECT image, x, y, (v1 > q1 OR v2 > q2) AS tissue FROM pixels JOIN q USING (image)"))
def tissue_mask_multichannel(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    mask = Mk.tissue_multichannel(p, ["v1", "v2"]).withColumn("tissue", F.lit(True))
    return p.select("image", "x", "y").join(mask, ["image", "x", "y"], "left").fillna(False, ["tissue"])


@query(V.with_views("pixels", "SELECT x, y, count(*) AS n_images, (count(*) = (SELECT count(DISTINCT image) FROM pixels WHERE v1 > 5)) AS in_all FROM pixels WHERE v1 > 5 GROUP BY x, y"))
def crop_mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Of each pixel position, the number of images with tissue there, and whether all have."""
    return P.coverage(V.pixels(spark, d).where("v1 > 5"))


@query(V.with_views("pixels", "SELECT min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM (SELECT x, y FROM pixels WHERE v1 > 2 GROUP BY x, y HAVING count(*) >= 8)"))
def non_rigid_region(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box of the pixels that most images cover."""
    return P.bounding_box(P.coverage(V.pixels(spark, d).where("v1 > 2")).where("n_images >= 8"))


@query(V.with_views("pixels", "SELECT image, x, y, CASE WHEN v2 > 100 THEN v1 ELSE 0 END AS masked, CASE WHEN v1 > 0 AND v2 > 0 THEN 2 WHEN v1 > 0 OR v2 > 0 THEN 1 ELSE 0 END AS overlap FROM pixels"))
def mask_applied(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    return p.select("image", "x", "y", P.applied_mask(F.col("v1"), F.col("v2") > 100).alias("masked"), P.overlap(F.col("v1") > 0, F.col("v2") > 0).alias("overlap"))


@query(V.with_views("pixels", "SELECT image, count(*) AS n, min(v1) AS lo, max(v1) AS hi, (min(v1) = max(v1)) AS is_empty, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image"))
def image_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of images, and which are empty: of one value only."""
    return P.shapes(V.pixels(spark, d), "v1")


HIST = "hist AS (SELECT image, v, n, sum(n) OVER (PARTITION BY image ORDER BY v)::DOUBLE / sum(n) OVER (PARTITION BY image) AS upto FROM (SELECT image, {0} AS v, count(*) AS n FROM pixels GROUP BY image, {0}))"


@query(V.with_views("pixels", "AND " + HIST.format("v1") + " SELECT image, v, n, round(upto, 6) AS upto FROM hist"))
def histograms(spark: SparkSession, d: str) -> DataFrame:
    return P.histogram(V.pixels(spark, d), "v1").select("image", "v", "n", R("upto"))


@query(
    V.with_views(
        "pixels",
        "AND h AS (SELECT v1 AS v, count(*) AS n FROM pixels GROUP BY v1), c AS (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER () AS upto, sum(n) OVER ()::BIGINT AS total FROM h), s AS (SELECT sum(v * n)::DOUBLE / sum(n) AS m FROM h) SELECT q::INT AS percent, (count(*) FILTER (WHERE upto <= q / 100.0::DOUBLE))::BIGINT AS levels, round(any_value(m), 6) AS mean FROM c, s, (VALUES (1), (5), (95), (99)) p(q) GROUP BY q",
    )
)
def pooled_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Of the pooled histogram of all images, the number of levels up to given percentages, and the mean."""
    return P.pooled_statistics(V.pixels(spark, d), "v1").select("percent", "levels", R("mean"))


@query(V.with_views("pixels", "AND " + HIST.format("v1") + ", " + HIST.format("v2").replace("hist AS", "ref AS", 1) + " SELECT s.image, s.v, (SELECT min(r.v) FROM ref r WHERE r.image = s.image AND r.upto >= s.upto) AS matched FROM hist s"))
def histogram_matching(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    return P.match_histograms(P.histogram(p, "v1"), P.histogram(p, "v2"))


@query(V.with_views("pixels", "AND b AS (SELECT image, x, y, round(v1 / 255.0::DOUBLE * 31)::INT AS bin FROM pixels) SELECT image, x, y, bin, round(-ln(count(*) OVER (PARTITION BY image, bin)::DOUBLE / count(*) OVER (PARTITION BY image)), 6) + 0.0 AS info FROM b"))
def self_information(spark: SparkSession, d: str) -> DataFrame:
    return P.shannon(V.pixels(spark, d), "v1", 32).select("image", "x", "y", "bin", (F.round("info", 6) + 0.0).alias("info"))


@query(
    V.with_views(
        "pixels",
        """AND t AS (SELECT image, floor(v1 * 16 / 256)::INT AS p, floor(v2 * 16 / 256)::INT AS q FROM pixels), j AS (SELECT image, p, q, count(*) AS n FROM t GROUP BY ALL), tot AS (SELECT image, sum(n) AS t FROM j GROUP BY image),
a AS (SELECT image, -sum(n / t * ln(n / t)) AS h FROM (SELECT image, p, sum(n)::DOUBLE AS n FROM j GROUP BY ALL) JOIN tot USING (image) GROUP BY image), b AS (SELECT image, -sum(n / t * ln(n / t)) AS h FROM (SELECT image, q, sum(n)::DOUBLE AS n FROM j GROUP BY ALL) JOIN tot USING (image) GROUP BY image),
c AS (SELECT image, -sum(n::DOUBLE / t * ln(n::DOUBLE / t)) AS h FROM j JOIN tot USING (image) GROUP BY image)
SELECT image, round(a.h, 6) AS h_a, round(b.h, 6) AS h_b, round(c.h, 6) AS h_ab, round((a.h + b.h) / c.h, 6) AS nmi FROM a JOIN b USING (image) JOIN c USING (image)""",
    )
)
def normalised_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return P.mutual_information(V.pixels(spark, d), "v1", "v2", 16).select("image", R("h_a"), R("h_b"), R("h_ab"), R("nmi"))


@query(V.with_views("pixels", "AND t AS (SELECT image, floor((v1 - min(v1) OVER w)::DOUBLE / nullif(max(v1) OVER w - min(v1) OVER w, 0) * 16 * (1 - 1e-9))::INT AS p, floor((v2 - min(v2) OVER w)::DOUBLE / nullif(max(v2) OVER w - min(v2) OVER w, 0) * 16 * (1 - 1e-9))::INT AS q FROM pixels WINDOW w AS (PARTITION BY image)) SELECT image, p, q, count(*) AS n FROM t GROUP BY GROUPING SETS ((image, p, q), (image, p), (image, q))"))
def joint_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Joint histogram of two bands with both margins; the margins have a null for the other band."""
    return P.joint_histogram(V.pixels(spark, d), "v1", "v2", 16)


@query(V.with_views("pixels", "SELECT image, round(avg((v1 - v2) * (v1 - v2)), 6) AS mse, round(avg((v1 - v2) * (v1 - v2)) FILTER (WHERE v2 > 100), 6) AS masked_mse FROM pixels GROUP BY image"))
def mean_squared_error(spark: SparkSession, d: str) -> DataFrame:
    return P.mean_squared_error(V.pixels(spark, d), "v1", "v2", F.col("v2") > 100).select("image", R("mse"), R("masked_mse"))


@query(
    V.with_views(
        "pixels",
        """AND h AS (SELECT image, v1 AS v, count(*) AS n FROM pixels GROUP BY ALL), r AS (SELECT image, v, sum(n) OVER a AS c, sum(v * n) OVER a AS s, sum(n) OVER (PARTITION BY image) AS tc, sum(v * n) OVER (PARTITION BY image) AS ts FROM h WINDOW a AS (PARTITION BY image ORDER BY v)),
e AS (SELECT image, v, round(c::DOUBLE * (tc - c) * pow(s::DOUBLE / c - (ts - s)::DOUBLE / (tc - c), 2) / (tc::DOUBLE * tc), 6) AS between_var FROM r WHERE tc > c) SELECT image, arg_max(v, (between_var, -v)) AS threshold, max(between_var) AS between_var FROM e GROUP BY image""",
    )
)
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The value that parts an image's histogram with the largest variance between both sides."""
    return P.otsu(V.pixels(spark, d), "v1")


@query(
    V.with_views(
        "pixels",
        """AND h AS (SELECT image, v1 AS v, count(*) AS n FROM pixels GROUP BY ALL), p AS (SELECT image, arg_max(v, (n, -v)) AS v0, max(n) AS n0, max(v) AS v9, arg_max(n, v) AS n9 FROM h GROUP BY image),
e AS (SELECT h.image, v, round(abs((n9 - n0)::DOUBLE * v - (v9 - v0)::DOUBLE * n + v9::DOUBLE * n0 - n9::DOUBLE * v0) / sqrt(pow(n9 - n0, 2) + pow(v9 - v0, 2)), 6) AS d FROM h JOIN p ON p.image = h.image WHERE v >= v0 AND v9 > v0)
SELECT image, arg_max(v, (d, -v)) AS threshold, max(d) AS distance FROM e GROUP BY image""",
    )
)
def unimodal_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The corner of a histogram: farthest from the line from its peak to its last value."""
    return P.unimodal_threshold(V.pixels(spark, d), "v1")


@query(V.with_views("pixels", "SELECT image, (x // 2)::INT AS x, (y // 2)::INT AS y, round(avg(v1), 6) AS v1, round(avg(v2), 6) AS v2 FROM pixels GROUP BY image, x // 2, y // 2"))
def downsampled(spark: SparkSession, d: str) -> DataFrame:
    return P.downsampled(V.pixels(spark, d), ["v1", "v2"]).select("image", "x", "y", R("v1"), R("v2"))


@query(V.with_views("pixels", "SELECT image, x - 8 AS x, y - 2 AS y, v1 FROM pixels WHERE x >= 8 AND x < 24 AND y >= 2 AND y < 3 + 17"))
def cropped(spark: SparkSession, d: str) -> DataFrame:
    return P.cropped(V.pixels(spark, d).select("image", "x", "y", "v1"), 8, 2, 16, 18)


@query(
    V.with_views(
        "pixels",
        """AND b AS (SELECT image, floor(v2 / 16)::INT AS hue, count(*) AS n FROM pixels GROUP BY ALL), l AS (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS q FROM b WINDOW w AS (PARTITION BY image ORDER BY hue))
SELECT image, hue, n, row_number() OVER (PARTITION BY image ORDER BY n DESC, hue)::INT AS rank FROM l WHERE n > coalesce(p, 0) AND n >= coalesce(q, 0)""",
    )
)
def dominant_hues(spark: SparkSession, d: str) -> DataFrame:
    """Local peaks of an image's histogram of hues, the most frequent first."""
    return P.histogram_peaks(V.pixels(spark, d), "v2", 16)


@query(V.with_views("pixels", "SELECT x, y, round(sum(v1 * r), 9) AS r, round(sum(v1 * g), 9) AS g FROM (SELECT x, y, v1, v1 / nullif(sum(v1) OVER (PARTITION BY x, y), 0) * (image % 3) AS r, v1 / nullif(sum(v1) OVER (PARTITION BY x, y), 0) * (image % 2) AS g FROM pixels) GROUP BY x, y"))
def blended_colours(spark: SparkSession, d: str) -> DataFrame:
    """Colours of images laid over each other, each in proportion to its part of the pixel's sum."""
    b = P.blended(V.pixels(spark, d), "v1", [F.col("image") % 3, F.col("image") % 2])
    return b.select("x", "y", F.round("c0", 9).alias("r"), F.round("c1", 9).alias("g"))


@query(V.with_views("pixels", "SELECT image, arg_min((x, y)::VARCHAR, (v1 + v2, y, x)) AS at, min(v1 + v2) AS darkest FROM pixels GROUP BY image"))
def background_pixel(spark: SparkSession, d: str) -> DataFrame:
    """The pixel of least summed intensity, the first of equals."""
    return P.background_pixel(V.pixels(spark, d), ["v1", "v2"]).select("image", F.format_string("(%d, %d)", "x", "y").alias("at"), "darkest")
"""Queries: descriptor matching, match filters, rigid estimation, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import affine as A
from tilewright.operators import estimate as E
from tilewright.operators import matching as M
from tilewright.plans import views as V
from tilewright.plans.registry import query
from tilewright.session import checkpointed

R = lambda c: F.round(F.col(c), 6).alias(c)

DIST = """pairs AS (SELECT DISTINCT image AS image1, image + 1 AS image2 FROM keypoints WHERE image + 1 IN (SELECT image FROM keypoints)),
dist AS (SELECT p.image1, p.image2, a.kp AS i, b.kp AS j, list_distance(a.descr, b.descr) AS d, a.descr AS da, b.descr AS db
  FROM pairs p JOIN keypoints a ON a.image = p.image1 JOIN keypoints b ON b.image = p.image2)"""
MUTUAL = (
    DIST
    + """, fwd AS (SELECT image1, image2, i, arg_min(j, (d, j)) AS j, min(d) AS d FROM dist GROUP BY ALL),
bwd AS (SELECT image1, image2, j, arg_min(i, (d, i)) AS i FROM dist GROUP BY image1, image2, j),
mutual AS (SELECT f.* FROM fwd f JOIN bwd b USING (image1, image2, i, j))"""
)
FIT = (
    MUTUAL
    + """, pts AS (SELECT m.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM mutual m JOIN keypoints a ON a.image = m.image1 AND a.kp = m.i JOIN keypoints b ON b.image = m.image2 AND b.kp = m.j),
mid AS (SELECT image1, image2, count(*) AS n, avg(x1) AS mx1, avg(y1) AS my1, avg(x2) AS mx2, avg(y2) AS my2 FROM pts GROUP BY ALL),
sums AS (SELECT image1, image2, n, mx1, my1, mx2, my2, sum((x1-mx1)*(x2-mx2)+(y1-my1)*(y2-my2)) AS dt, sum((x1-mx1)*(y2-my2)-(y1-my1)*(x2-mx2)) AS cr, sum((x1-mx1)*(x1-mx1)+(y1-my1)*(y1-my1)) AS sz
  FROM pts JOIN mid USING (image1, image2) GROUP BY ALL),
fit AS (SELECT image1, image2, n, dt/nullif(sz,0) AS a, cr/nullif(sz,0) AS b, mx2 - dt/nullif(sz,0)*mx1 + cr/nullif(sz,0)*my1 AS tx, my2 - cr/nullif(sz,0)*mx1 - dt/nullif(sz,0)*my1 AS ty FROM sums),
res AS (SELECT p.*, sqrt(pow(f.a*x1 - f.b*y1 + f.tx - x2, 2) + pow(f.b*x1 + f.a*y1 + f.ty - y2, 2)) AS r FROM pts p JOIN fit f USING (image1, image2)),
fence AS (SELECT image1, image2, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM res GROUP BY ALL),
kept AS (SELECT res.* FROM res JOIN fence USING (image1, image2) WHERE r > q1 - 3*(q3-q1) AND r < q3 + 3*(q3-q1))"""
)


def mutual(spark: SparkSession, d: str) -> DataFrame:
    kp = V.keypoints(spark, d)
    return M.match_pairs(kp, M.neighbour_pairs(kp))


def matched_points(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(M.with_points(mutual(spark, d), V.keypoints(spark, d)))


@query(V.with_views("keypoints", "AND " + MUTUAL + " SELECT image1, image2, i, j, round(d, 6) AS d FROM mutual"))
def match_mutual_nearest(spark: SparkSession, d: str) -> DataFrame:
    return mutual(spark, d).select("image1", "image2", "i", "j", R("d"))


@query(V.with_views("keypoints", "AND " + MUTUAL + " SELECT image1, image2, i, j, round(d, 6) AS d FROM fwd WHERE d < 1.2"))
def match_within_distance(spark: SparkSession, d: str) -> DataFrame:
    kp = V.keypoints(spark, d)
    return M.match_pairs(kp, M.neighbour_pairs(kp), cross_check=False, max_distance=1.2).select("image1", "image2", "i", "j", R("d"))


@query(
    V.with_views(
        "keypoints",
        "AND " + DIST + """, ranked AS (SELECT image1, image2, i, j, d, row_number() OVER w AS k, lead(d) OVER w AS second FROM dist WINDOW w AS (PARTITION BY image1, image2, i ORDER BY d, j))
SELECT image1, image2, i, j, round(d, 6) AS d FROM ranked WHERE k = 1 AND (second IS NULL OR d < 0.95 * second)""",
    )
)
def match_ratio_test(spark: SparkSession, d: str) -> DataFrame:
    kp = V.keypoints(spark, d)
    return M.match_pairs(kp, M.neighbour_pairs(kp), cross_check=False, max_ratio=0.95).select("image1", "image2", "i", "j", R("d"))


@query(
    V.with_views(
        "keypoints",
        "AND " + DIST + """ SELECT image1, image2, round(min(list_sum(list_transform(range(1, 65), lambda k: abs(da[k] - db[k])))), 6) AS manhattan,
  round(min(list_max(list_transform(range(1, 65), lambda k: abs(da[k] - db[k])))), 6) AS chebyshev, round(min(1 - list_sum(list_transform(range(1, 65), lambda k: da[k] * db[k])) / (sqrt(list_sum(list_transform(da, lambda x: x * x))) * sqrt(list_sum(list_transform(db, lambda x: x * x))))), 6) AS cosine,
  round(min(list_sum(list_transform(range(1, 65), lambda k: CASE WHEN da[k] <> db[k] THEN 1.0 ELSE 0.0 END))::DOUBLE / 64), 6) AS hamming FROM dist GROUP BY image1, image2""",
    )
)
def match_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The least distance of a pair's descriptors by other metrics."""
    kp = V.keypoints(spark, d)
    pairs, out = M.neighbour_pairs(kp), None
    for m in ("manhattan", "chebyshev", "cosine", "hamming"):
        least = M.match_pairs(kp, pairs, m, cross_check=False).groupBy("image1", "image2").agg(F.round(F.min("d"), 6).alias(m))
        out = least if out is None else out.join(least, ["image1", "image2"])
    return out


@query(V.with_views("keypoints", "AND " + MUTUAL + " SELECT image1, image2, count(*) AS n, round(avg(d), 6) AS mean_d, round(exp(-avg(d) / 64), 6) AS similarity, round(-ln(exp(-avg(d) / 64) + 2.220446049250313e-16) * 64, 6) AS distance FROM mutual GROUP BY ALL"))
def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.match_summary(mutual(spark, d), 64)


@query(V.with_views("keypoints", "AND " + FIT + " SELECT image1, image2, n, round(a, 6) AS a, round(b, 6) AS b, round(tx, 6) AS tx, round(ty, 6) AS ty FROM fit"))
def rigid_similarity_fit(spark: SparkSession, d: str) -> DataFrame:
    return M.fit_similarity(matched_points(spark, d)).select("image1", "image2", "n", R("a"), R("b"), R("tx"), R("ty"))


@query(V.with_views("keypoints", "AND " + FIT + " SELECT image1, image2, i, j, round(r, 6) AS r FROM kept"))
def match_tukey_filter(spark: SparkSession, d: str) -> DataFrame:
    m = matched_points(spark, d)
    return M.tukey_filter(M.residuals(m, M.fit_similarity(m))).select("image1", "image2", "i", "j", R("r"))


def _error_sql() -> str:
    again = FIT.split("mid AS", 1)[1].split(",\nfence AS", 1)[0]
    second = "mid2 AS" + again.replace("FROM pts JOIN mid ", "FROM kept JOIN mid2 ").replace("FROM pts GROUP", "FROM kept GROUP").replace("\nsums AS", "\nsums2 AS").replace("FROM sums)", "FROM sums2)").replace("\nfit AS", "\nfit2 AS").replace("\nres AS (SELECT p.*,", "\nres2 AS (SELECT p.image1, p.image2, x1, y1, x2, y2,").replace("FROM pts p JOIN fit f", "FROM kept p JOIN fit2 f")
    return V.with_views(
        "keypoints",
        "AND " + FIT + ", " + second + """ SELECT image1, image2, count(*) AS n, round(median(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2))), 6) AS original_d, round(median(r), 6) AS rigid_d,
  round(median(r / sqrt(512.0 * 512 + 512.0 * 512)::DOUBLE), 6) AS rigid_rtre FROM res2 GROUP BY ALL""",
    )


@query(_error_sql())
def register_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Match, filter, fit, warp and measure: the errors of each pair of neighbouring images."""
    return E.register_pairs(V.keypoints(spark, d), (512.0, 512.0)).select("image1", "image2", "n", R("original_d"), R("rigid_d"), R("rigid_rtre"))


@query(
    V.with_views(
        "keypoints",
        "AND " + MUTUAL + """, s AS (SELECT image1, image2, count(*) AS value FROM mutual GROUP BY ALL), two AS (SELECT image1 AS a, image2 AS b, value FROM s UNION ALL SELECT image2, image1, value FROM s),
mat AS (SELECT a, b, value::DOUBLE / (SELECT max(value) FROM two)::DOUBLE AS similarity FROM two UNION ALL SELECT DISTINCT a, a, 1.0::DOUBLE FROM two)
SELECT a, b, round(similarity, 6) AS similarity, round(1 - similarity, 6) AS distance FROM mat""",
    )
)
def stack_metric_matrix(spark: SparkSession, d: str) -> DataFrame:
    s = mutual(spark, d).groupBy("image1", "image2").agg(F.count(F.lit(1)).alias("value"))
    return M.metric_matrix(s).select("a", "b", R("similarity"), R("distance"))


@query(V.with_views("keypoints", "SELECT image, kp, round(response, 6) AS response, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY response DESC, kp)::INT AS k FROM keypoints) WHERE k <= 20"))
def features_top_k(spark: SparkSession, d: str) -> DataFrame:
    return M.top_features(V.keypoints(spark, d), 20).select("image", "kp", R("response"), "rank")


@query(
    V.with_views(
        "keypoints",
        """AND ref AS (SELECT CASE WHEN count(DISTINCT image) = 2 THEN 0 ELSE count(DISTINCT image) // 2 END AS r, max(image) AS most FROM keypoints)
SELECT step::INT AS step, moving::INT AS moving, fixed::INT AS fixed FROM (
  SELECT r - k - 1 AS moving, r - k AS fixed, k AS step FROM (SELECT r, unnest(range(0, r)) AS k FROM ref)
  UNION ALL SELECT k + 1, k, k FROM (SELECT r, unnest(range(r, most)) AS k FROM ref))""",
    )
)
def alignment_schedule(spark: SparkSession, d: str) -> DataFrame:
    return E.alignment_schedule(V.keypoints(spark, d).select("image"))


@query(
    V.with_views(
        "keypoints",
        "AND RECURSIVE_PLACEHOLDER",
    ).replace("WITH keypoints", "WITH RECURSIVE keypoints").replace(
        "RECURSIVE_PLACEHOLDER",
        FIT + """, chain(image, a, b, tx, ty) AS (
  SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT f.image2, f.a * c.a - f.b * c.b, f.a * c.b + f.b * c.a, f.a * c.tx - f.b * c.ty + f.tx, f.b * c.tx + f.a * c.ty + f.ty FROM chain c JOIN fit f ON f.image1 = c.image)
SELECT image::INT AS image, round(a, 6) AS a, round(b, 6) AS b, round(tx, 6) AS tx, round(ty, 6) AS ty FROM chain""",
    )
)
def transform_chain(spark: SparkSession, d: str) -> DataFrame:
    """Transforms from the first image of the stack to each other one, chained over neighbours."""
    fits = M.fit_similarity(matched_points(spark, d)).selectExpr("image2 as image", "array(a, -b, tx, b, a, ty, 0.0D, 0.0D, 1.0D) as m")
    c = E.chain(fits)
    at = lambda k: F.get("m", F.lit(k))
    return c.select("image", *[F.round(at(k), 6).alias(n) for k, n in ((0, "a"), (3, "b"), (2, "tx"), (5, "ty"))])


@query(
    V.with_views(
        "keypoints",
        "AND " + FIT + """, cmp AS (SELECT image1, image2, avg(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2))) AS before, avg(r) AS after FROM res GROUP BY ALL)
SELECT image1, image2, round(before, 6) AS before, round(after, 6) AS after, round(CASE WHEN after > before THEN 1.0 ELSE a END, 6) AS a, round(CASE WHEN after > before THEN 0.0 ELSE b END, 6) AS b FROM cmp JOIN fit USING (image1, image2)""",
    )
)
def rigid_guard(spark: SparkSession, d: str) -> DataFrame:
    """The fit of a pair, or the identity where it takes points further apart."""
    m = matched_points(spark, d)
    f = M.fit_similarity(m)
    gap = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    both = M.residuals(m, f).groupBy("image1", "image2").agg(F.avg(gap).alias("before"), F.avg("r").alias("after"))
    return both.join(E.guarded(m, f, max_scale=1e9), ["image1", "image2"]).select("image1", "image2", R("before"), R("after"), R("a"), R("b"))


_REFLECT = FIT.split("pts AS", 1)
_REFLECT_SQL = (
    _REFLECT[0]
    + "raw AS"
    + _REFLECT[1].split(",\nmid AS", 1)[0]
    + """, flips(fx, fy) AS (VALUES (false, false), (true, false), (false, true), (true, true)),
pts AS (SELECT image1, image2, fx, fy, CASE WHEN fx THEN 511.0 - x1 ELSE x1 END AS x1, CASE WHEN fy THEN 511.0 - y1 ELSE y1 END AS y1, x2, y2 FROM raw, flips),
mid AS (SELECT image1, image2, fx, fy, avg(x1) AS mx1, avg(y1) AS my1, avg(x2) AS mx2, avg(y2) AS my2 FROM pts GROUP BY ALL),
f AS (SELECT image1, image2, fx, fy, mx1, my1, mx2, my2, sum((x1-mx1)*(x2-mx2)+(y1-my1)*(y2-my2)) / nullif(sum((x1-mx1)*(x1-mx1)+(y1-my1)*(y1-my1)), 0) AS a, sum((x1-mx1)*(y2-my2)-(y1-my1)*(x2-mx2)) / nullif(sum((x1-mx1)*(x1-mx1)+(y1-my1)*(y1-my1)), 0) AS b
  FROM pts JOIN mid USING (image1, image2, fx, fy) GROUP BY ALL),
e AS (SELECT image1, image2, fx, fy, median(sqrt(pow(a*(x1-mx1) - b*(y1-my1) + mx2 - x2, 2) + pow(b*(x1-mx1) + a*(y1-my1) + my2 - y2, 2))) AS err FROM pts JOIN f USING (image1, image2, fx, fy) GROUP BY ALL)
SELECT image1, image2, arg_min(fx, (round(err, 6), fx, fy)) AS flip_x, arg_min(fy, (round(err, 6), fx, fy)) AS flip_y, round(min(err), 6) AS err FROM e GROUP BY ALL"""
)


@query(V.with_views("keypoints", "AND " + _REFLECT_SQL))
def rigid_reflections(spark: SparkSession, d: str) -> DataFrame:
    """Of no mirror, x, y and both, the one that leaves the smallest median error."""
    return E.best_reflection(matched_points(spark, d), 512.0, 512.0).select("image1", "image2", "flip_x", "flip_y", R("err"))


@query(
    V.with_views(
        "keypoints",
        "AND " + FIT + """, prv AS (SELECT image2 AS image, floor(x2 / 50)::INT AS cx, floor(y2 / 50)::INT AS cy FROM pts), nxt AS (SELECT image1 AS image, floor(x1 / 50)::INT AS cx, floor(y1 / 50)::INT AS cy FROM pts)
SELECT image, cx, cy FROM (SELECT * FROM prv INTERSECT SELECT * FROM nxt)""",
    )
)
def neighbour_match_bins(spark: SparkSession, d: str) -> DataFrame:
    """Cells of an image that are hit by matches to both its neighbours."""
    m = matched_points(spark, d)
    cell = lambda image, x, y: m.select(F.col(image).alias("image"), F.floor(F.col(x) / 50).cast("int").alias("cx"), F.floor(F.col(y) / 50).cast("int").alias("cy"))
    return cell("image2", "x2", "y2").intersect(cell("image1", "x1", "y1"))


@query(
    V.with_views(
        "keypoints",
        "AND " + FIT + """, old AS (SELECT image1, image2, count(*) AS n_old, avg(r) AS d_old FROM res GROUP BY ALL), new AS (SELECT image1, image2, count(*) AS n_new, avg(r) AS d_new FROM kept GROUP BY ALL)
SELECT image1, image2, n_old, n_new, CASE WHEN d_new < d_old AND n_new > n_old THEN 'replace' WHEN d_new >= d_old AND n_new <= n_old THEN 'keep' ELSE 'merge' END AS decision FROM old JOIN new USING (image1, image2)""",
    )
)
def rematch_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether new matches of a pair replace the old ones, are dropped, or are joined with them."""
    m = matched_points(spark, d)
    r = M.residuals(m, M.fit_similarity(m))
    return E.rematch_decision(r, M.tukey_filter(r))


@query(
    V.with_views(
        "keypoints",
        "AND " + FIT + """, e AS (SELECT image1, image2, median(r) AS err, count(*) AS n FROM res GROUP BY ALL), w AS (SELECT *, (row_number() OVER (ORDER BY image1) - 1) AS i, count(*) OVER () AS total FROM e)
SELECT round(sum((total - abs(i - total / 2.0)) * err) / sum(total - abs(i - total / 2.0)), 6) AS total_error, round(sum(n * err) / sum(n), 6) AS mean_by_matches FROM w""",
    )
)
def total_error(spark: SparkSession, d: str) -> DataFrame:
    m = matched_points(spark, d)
    e = M.residuals(m, M.fit_similarity(m)).groupBy("image1", "image2").agg(F.percentile("r", 0.5).alias("err"), F.count(F.lit(1)).alias("n"))
    return E.total_error(e, "image1").select(R("total_error"), R("mean_by_matches"))


@query(
    V.with_views(
        "keypoints",
        "AND " + FIT + """, w AS (SELECT image1, image2, r, exp(-d / 64) AS wt, sum(exp(-d / 64)) OVER (PARTITION BY image1, image2 ORDER BY r, i) AS upto, sum(exp(-d / 64)) OVER (PARTITION BY image1, image2) AS whole FROM res)
SELECT image1, image2, round(min(r) FILTER (WHERE upto >= 0.5 * whole), 6) AS weighted_median FROM w GROUP BY ALL""",
    )
)
def weighted_median_error(spark: SparkSession, d: str) -> DataFrame:
    """Median of errors weighted by the similarity of the descriptors."""
    m = matched_points(spark, d)
    return E.weighted_median(M.residuals(m, M.fit_similarity(m)).withColumn("w", F.exp(-F.col("d") / 64))).select("image1", "image2", R("weighted_median"))


@query(V.with_views("keypoints", "AND " + FIT + " SELECT image1, image2, i, j FROM pts WHERE x1 >= 200 AND x1 < 320 AND y1 >= 200 AND y1 < 320 AND x2 >= 200 AND x2 < 320 AND y2 >= 200 AND y2 < 320"))
def matches_inside_mask(spark: SparkSession, d: str) -> DataFrame:
    """Matches of which both points are in the mask, here a polygon."""
    box = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((200, 200), (320, 200), (320, 320), (200, 320))])
    return matched_points(spark, d).where(A.point_in_polygon(F.col("x1"), F.col("y1"), box) & A.point_in_polygon(F.col("x2"), F.col("y2"), box)).select("image1", "image2", "i", "j")


@query(
    V.with_views(
        "keypoints",
        "AND " + DIST + """, fw AS (SELECT image1, image2, i, arg_min(j, (d, j)) AS j FROM dist GROUP BY ALL), c AS (SELECT f.image1, f.image2, f.i, f.j, floor(a.x / 25.6)::INT AS cx, floor(a.y / 25.6)::INT AS cy, floor(b.x / 25.6)::INT AS ex, floor(b.y / 25.6)::INT AS ey
  FROM fw f JOIN keypoints a ON a.image = f.image1 AND a.kp = f.i JOIN keypoints b ON b.image = f.image2 AND b.kp = f.j),
cells AS (SELECT image1, image2, cx, cy, ex, ey, count(*) AS n FROM c GROUP BY ALL), own AS (SELECT image1, image2, cx, cy, sum(n)::BIGINT AS total FROM cells GROUP BY ALL)
SELECT c.image1, c.image2, c.cx, c.cy, c.ex, c.ey, c.n, sum(o.n)::BIGINT AS support, (sum(o.n) >= 6 * sqrt(any_value(own.total) / 9.0)) AS accepted
FROM cells c JOIN (VALUES (-1), (0), (1)) dx(dx) ON true JOIN (VALUES (-1), (0), (1)) dy(dy) ON true JOIN cells o ON o.image1 = c.image1 AND o.image2 = c.image2 AND o.cx = c.cx + dx AND o.cy = c.cy + dy AND o.ex = c.ex + dx AND o.ey = c.ey + dy
JOIN own ON own.image1 = c.image1 AND own.image2 = c.image2 AND own.cx = c.cx AND own.cy = c.cy GROUP BY ALL""",
    )
)
def grid_motion_support(spark: SparkSession, d: str) -> DataFrame:
    """Support of cell-to-cell motions by the same motion of the eight cells around."""
    kp = V.keypoints(spark, d)
    m = M.with_points(M.match_pairs(kp, M.neighbour_pairs(kp), cross_check=False), kp)
    return E.grid_motion(m, 25.6, 6.0)


@query(V.with_views("keypoints", "AND " + FIT + " SELECT image1, image2, round(degrees(atan2(b, a)), 6) AS rotation_deg, round(sqrt(a * a + b * b), 6) AS scale, (sqrt(a * a + b * b) < 5 AND sqrt(a * a + b * b) > 1 / 5.0) AS scale_ok FROM fit"))
def rotation_and_scale(spark: SparkSession, d: str) -> DataFrame:
    """Rotation of a fit in degrees, its scale, and whether the scale passes the guard."""
    f = M.fit_similarity(matched_points(spark, d)).withColumn("scale", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")))
    return f.select("image1", "image2", F.round(F.degrees(F.atan2("b", "a")), 6).alias("rotation_deg"), R("scale"), ((F.col("scale") < 5) & (F.col("scale") > 1 / 5)).alias("scale_ok"))


@query(V.with_views("keypoints", "AND pair AS (SELECT a.image AS image1, b.image AS image2 FROM (SELECT DISTINCT image FROM keypoints) a JOIN (SELECT DISTINCT image FROM keypoints) b ON a.image < b.image) SELECT image1, image2, (image2 - image1 = 1) AS neighbours FROM pair"))
def image_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of images of a stack, as it is ordered by them, and which are next to each other."""
    return M.all_pairs(V.keypoints(spark, d)).select("image1", "image2", (F.col("image2") - F.col("image1") == 1).alias("neighbours"))


@query(V.with_views("keypoints", "SELECT image, ceil(greatest(w, h, (w + h) * sqrt(0.5)))::BIGINT AS canvas FROM (SELECT image, max(x) - min(x) AS w, max(y) - min(y) AS h FROM keypoints GROUP BY image)"))
def detection_canvas(spark: SparkSession, d: str) -> DataFrame:
    """Side of a square that holds an image however it is turned in steps of 45 degrees."""
    s = V.keypoints(spark, d).groupBy("image").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return s.select("image", F.ceil(F.greatest("w", "h", (F.col("w") + F.col("h")) * F.sqrt(F.lit(0.5)))).alias("canvas"))

"""Queries: colour spaces, stains and what is made of them, over three bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import colour as C
from tilewright.kernels import colour as K
from tilewright.operators import masks as Mk
from tilewright.operators import raster as P
from tilewright.operators import stain as S
from tilewright.plans import views as V
from tilewright.plans.registry import query

RGB = ["v1", "v2", "v3"]
KEY = ["image", "x", "y"]
R = lambda c, n=6: (F.round(F.col(c), n) + 0.0).alias(c)


def _num(x: float) -> str:
    return f"({float(x)!r})::DOUBLE"


def _dot(row: object, names: str) -> str:
    return " + ".join(f"{_num(k)} * {n}" for k, n in zip(row, names.split(), strict=True))


LINEAR = "lin AS (SELECT image, x, y, " + ", ".join(f"CASE WHEN v{k}/255.0::DOUBLE <= 0.04045 THEN v{k}/255.0::DOUBLE/12.92 ELSE pow((v{k}/255.0::DOUBLE + 0.055)/1.055, 2.4) END AS {c}" for k, c in ((1, "lr"), (2, "lg"), (3, "lb"))) + " FROM pixels)"
XYZ = LINEAR + ", xyz AS (SELECT image, x, y, " + ", ".join(f"{_dot(row, 'lr lg lb')} AS {c}" for row, c in zip(K.RGB_TO_XYZ, ("cx", "cy", "cz"), strict=True)) + " FROM lin)"


def _cam16() -> str:
    k = K.cam16_constants()
    sharp = ", ".join(f"({_dot(100 * row, 'cx cy cz')}) * {_num(g)} AS {c}" for row, g, c in zip(K.M16, k["gain"], ("r", "g", "b"), strict=True))
    power = lambda c: f"pow({_num(k['f_l'] / 100)} * abs({c}), 0.42)"
    adapted = ", ".join(f"400 * sign({c}) * {power(c)} / ({power(c)} + 27.13) + 0.1 AS {c}a" for c in "rgb")
    light = f"100 * pow(greatest(2*ra + ga + ba/20 - 0.305, 0) * {_num(k['n_bb'] / k['a_w'])}, {_num(K.C_SURROUND * k['z'])})"
    t = f"{_num(50000 / 13 * K.N_C * k['n_bb'])} * (cos(h + 2) + 3.8) / 4 * sqrt(p*p + q*q) / total"
    chroma = float((1.64 - 0.29 ** k["n"]) ** 0.73 * k["f_l"] ** 0.25)
    return (
        XYZ + f", sharp AS (SELECT image, x, y, {sharp} FROM xyz), adapted AS (SELECT image, x, y, {adapted} FROM sharp), opp AS (SELECT image, x, y, {light} AS light, ra - 12*ga/11 + ba/11 AS p, (ra + ga - 2*ba)/9 AS q, ra + ga + 21*ba/20 AS total FROM adapted)"
        f", hue AS (SELECT *, atan2(q, p) AS h FROM opp), strong AS (SELECT image, x, y, light, h, pow(greatest({t}, 0), 0.9) * sqrt(light / 100) * {_num(chroma)} AS m FROM hue)"
        ", jab AS (SELECT image, x, y, 1.7 * light / (1 + 0.007 * light) / 100 AS j, ln(1 + 0.0228 * m) / 2.28 * cos(h) AS a, ln(1 + 0.0228 * m) / 2.28 * sin(h) AS b FROM strong)"
    )


def _jzazbz() -> str:
    lms = ", ".join(f"{_dot(row, 'x1 y1 cz')} AS {c}" for row, c in zip(K.JZ_LMS, ("l", "m", "s"), strict=True))
    power = lambda c: f"pow(greatest({c}, 0) / 10000, {_num(K.PQ_N)})"
    pq = ", ".join(f"pow(({_num(K.PQ_C1)} + {_num(K.PQ_C2)} * {power(c)}) / (1 + {_num(K.PQ_C3)} * {power(c)}), {_num(K.PQ_P)}) AS {c}p" for c in "lms")
    iab = ", ".join(f"{_dot(row, 'lp mp sp')} AS {c}" for row, c in zip(K.JZ_IAB, ("i", "a", "b"), strict=True))
    return (
        XYZ + f", shifted AS (SELECT image, x, y, {K.JZ_B} * cx - {K.JZ_B - 1} * cz AS x1, {K.JZ_G} * cy - ({K.JZ_G - 1}) * cx AS y1, cz FROM xyz), lms AS (SELECT image, x, y, {lms} FROM shifted), pq AS (SELECT image, x, y, {pq} FROM lms)"
        f", iab AS (SELECT image, x, y, {iab} FROM pq), jab AS (SELECT image, x, y, (1 + ({K.JZ_D})) * i / (1 + ({K.JZ_D}) * i) - {_num(K.JZ_D0)} AS j, a, b FROM iab)"
    )


HUNTER = XYZ + f", rel AS (SELECT image, x, y, cx / {_num(K.HUNTER_WHITE[0])} AS cx, cy, cz / {_num(K.HUNTER_WHITE[2])} AS cz, sqrt(greatest(cy, {_num(K.EPS)})) AS j FROM xyz), jab AS (SELECT image, x, y, j, {K.HUNTER_K[0]} * (cx - cy) / j AS a, {K.HUNTER_K[1]} * (cy - cz) / j AS b FROM rel)"
IHLS = """unit AS (SELECT image, x, y, v1/255.0::DOUBLE AS r, v2/255.0::DOUBLE AS g, v3/255.0::DOUBLE AS b FROM pixels), size AS (SELECT *, sqrt(greatest(r*r + g*g + b*b - r*g - r*b - g*b, 0)) AS s FROM unit),
ihls AS (SELECT image, x, y, coalesce(CASE WHEN b > g THEN 2 * 3.141592653589793::DOUBLE - acos(least(greatest((r - g/2 - b/2) / nullif(s, 0), -1), 1)) ELSE acos(least(greatest((r - g/2 - b/2) / nullif(s, 0), -1), 1)) END, 0) AS hue,
  0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b AS luminance, greatest(r, g, b) - least(r, g, b) AS saturation, s FROM size)"""
JAB = "SELECT image, x, y, round(j, 6) + 0.0 AS j, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM jab"


@query(V.with_views("pixels", f"AND {_cam16()} {JAB}"))
def colours_cam16(spark: SparkSession, d: str) -> DataFrame:
    return C.rgb_to_jab(V.pixels(spark, d).select(*KEY, *RGB), RGB).select(*KEY, R("j"), R("a"), R("b"))


@query(V.with_views("pixels", f"AND {_jzazbz()} SELECT image, x, y, round(j, 8) + 0.0 AS j, round(a, 8) + 0.0 AS a, round(b, 8) + 0.0 AS b FROM jab"))
def colours_jzazbz(spark: SparkSession, d: str) -> DataFrame:
    return C.rgb_to_jab(V.pixels(spark, d).select(*KEY, *RGB), RGB, "JzAzBz").select(*KEY, R("j", 8), R("a", 8), R("b", 8))


@query(V.with_views("pixels", f"AND {HUNTER} {JAB}"))
def colours_hunter(spark: SparkSession, d: str) -> DataFrame:
    return C.rgb_to_jab(V.pixels(spark, d).select(*KEY, *RGB), RGB, "HunterLab").select(*KEY, R("j"), R("a"), R("b"))


@query(V.with_views("pixels", f"AND {IHLS} SELECT image, x, y, round(luminance, 6) AS luminance, round(saturation, 6) AS saturation, CASE WHEN s > 0.02 THEN round(hue, 5) END AS hue FROM ihls"))
def colours_ihls(spark: SparkSession, d: str) -> DataFrame:
    """Luminance, saturation and, of colours that aren't nearly grey, hue."""
    v = C.rgb_to_ihls(*[F.col(b) for b in RGB])
    r, g, b = (F.col(c) / 255.0 for c in RGB)
    size = F.sqrt(F.greatest(r * r + g * g + b * b - r * g - r * b - g * b, F.lit(0.0)))
    p = V.pixels(spark, d).select(*KEY, v.alias("v"), size.alias("s"))
    return p.select(*KEY, F.round("v.luminance", 6).alias("luminance"), F.round("v.saturation", 6).alias("saturation"), F.when(F.col("s") > 0.02, F.round("v.hue", 5)).alias("hue"))


@query()
def colours_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How far colours are from themselves, in parts of 255, after a way to each space and back."""
    p, out = V.pixels(spark, d).select(*KEY, *RGB), None
    for s in K.SPACES:
        back = C.jab_to_rgb(C.rgb_to_jab(p, RGB, s), ["j", "a", "b"], s, ("r2", "g2", "b2"))
        gap = F.greatest(*[F.abs(F.col(c) * 255 - F.col(b)) for c, b in zip(("r2", "g2", "b2"), RGB, strict=True)])
        one = back.groupBy("image").agg(F.round(F.max(gap), 6).alias("gap")).withColumn("space", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query(V.with_views("pixels", "SELECT image, x, y, round(0.2125::DOUBLE * v1 / 255 + 0.7154::DOUBLE * v2 / 255 + 0.0721::DOUBLE * v3 / 255, 6) AS gray FROM pixels"))
def gray(spark: SparkSession, d: str) -> DataFrame:
    return V.pixels(spark, d).select(*KEY, F.round(S.grey(RGB), 6).alias("gray"))


@query(V.with_views("pixels", f"AND {_cam16()}, lim AS (SELECT image, min(255 - j * 255) AS lo, max(255 - j * 255) AS hi FROM jab GROUP BY image) SELECT image, x, y, floor(round((255 - j * 255 - lo) / (hi - lo) * 255, 6))::INT AS v FROM jab JOIN lim USING (image)"))
def luminosity(spark: SparkSession, d: str) -> DataFrame:
    """Dark on light turned round: lightness as it is seen, stretched over each image."""
    lit = C.rgb_to_jab(V.pixels(spark, d).select(*KEY, *RGB), RGB).select(*KEY, (255 - F.col("j") * 255).alias("v"))
    return S.stretched(lit, "v", whole=False).select(*KEY, F.floor(F.round("v", 6)).cast("int").alias("v"))


@query()
def colourfulness_standardised(spark: SparkSession, d: str) -> DataFrame:
    return S.standardise_colourfulness(V.pixels(spark, d), RGB)


@query(
    V.with_views(
        "pixels",
        f"""AND {IHLS}, s AS (SELECT image, x, y, (luminance - min(luminance) OVER w) / nullif(max(luminance) OVER w - min(luminance) OVER w, 0) AS j, (saturation - min(saturation) OVER w) / nullif(max(saturation) OVER w - min(saturation) OVER w, 0) AS c FROM ihls WINDOW w AS (PARTITION BY image)),
q AS (SELECT image, quantile_cont(j, 0.99) AS j0, quantile_cont(c, 0.01) AS c0 FROM s GROUP BY image) SELECT image, x, y, round(sqrt(pow(j - j0, 2) + pow(c - c0, 2)), 6) AS euclidean, round(greatest(abs(j - j0), abs(c - c0)), 6) AS chebyshev FROM s JOIN q USING (image)""",
    )
)
def lightness_colourfulness_distance(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    a, b = (S.lightness_colourfulness_distance(p, RGB, 99, m).withColumnRenamed("d", m) for m in ("euclidean", "chebyshev"))
    return a.join(b, KEY).select(*KEY, R("euclidean"), R("chebyshev"))


@query(V.with_views("pixels", f"AND {_cam16()}, q AS (SELECT image, quantile_cont(j, 0.99) AS t FROM jab GROUP BY image), bg AS (SELECT image, avg(j) AS mj, avg(a) AS ma, avg(b) AS mb FROM jab JOIN q USING (image) WHERE j >= t GROUP BY image) SELECT image, x, y, round(sqrt(pow(j - mj, 2) + pow(a - ma, 2) + pow(b - mb, 2)), 6) AS d FROM jab JOIN bg USING (image)"))
def colour_background_distance(spark: SparkSession, d: str) -> DataFrame:
    return S.background_distance(V.pixels(spark, d), RGB).select(*KEY, R("d"))


STAINS = np.array([[70, 60, 140], [200, 90, 150], [230, 225, 220]])
UNMIX = K.unmixing_matrix(STAINS)
OD3 = "od AS (SELECT image, x, y, " + ", ".join(f"greatest(-log10(v{k} / 255.0::DOUBLE + 2.220446049250313e-16), 0) AS o{k}" for k in (1, 2, 3)) + " FROM pixels)"


@query(V.with_views("pixels", f"AND {OD3} SELECT image, x, y, " + ", ".join(f"round({_dot(UNMIX[:, k], 'o1 o2 o3')}, 6) + 0.0 AS stain{k + 1}" for k in range(3)) + " FROM od"))
def stains_unmixed(spark: SparkSession, d: str) -> DataFrame:
    """How much there is of three stains, by optical densities."""
    return S.unmix(V.pixels(spark, d), RGB, UNMIX).select(*KEY, R("stain1"), R("stain2"), R("stain3"))


@query()
def stain_vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.stain_vectors(V.pixels(spark, d), RGB)


@query()
def haematoxylin(spark: SparkSession, d: str) -> DataFrame:
    return S.haematoxylin_eosin(V.pixels(spark, d), RGB, "hem")


@query()
def stains_flattened(spark: SparkSession, d: str) -> DataFrame:
    return S.flatten_stains(V.pixels(spark, d), RGB, 8)


@query()
def dominant_image_colours(spark: SparkSession, d: str) -> DataFrame:
    return S.dominant_colours(V.pixels(spark, d), RGB)


@query()
def colours_quantised(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    return S.quantise(p, RGB, S.dominant_colours(p, RGB))


def _similar_sql() -> str:
    own = K.rgb_to_jab(STAINS / 255, "JzAzBz")
    unit = lambda v, c: f"coalesce(({v} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0), 0)"
    gaps = [" + ".join(f"pow({unit(c, c)} - {unit(_num(v), c)}, 2)" for v, c in zip(row, "jab", strict=True)) for row in own]
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "jab")
    return V.with_views(
        "pixels",
        f"AND {_jzazbz()}, ends AS (SELECT image, {ends} FROM jab GROUP BY image), dist AS (SELECT image, x, y, " + ", ".join(f"sqrt({g}) AS d{k + 1}" for k, g in enumerate(gaps)) + " FROM jab JOIN ends USING (image)), lim AS (SELECT image, least(min(d1), min(d2), min(d3)) AS lo, greatest(max(d1), max(d2), max(d3)) AS hi FROM dist GROUP BY image)"
        " SELECT image, x, y, " + ", ".join(f"round(1 - (d{k} - lo) / (hi - lo), 5) + 0.0 AS colour{k}" for k in (1, 2, 3)) + " FROM dist JOIN lim USING (image)",
    )


@query(_similar_sql())
def colour_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How like three colours each pixel is."""
    s = S.colour_similarity(V.pixels(spark, d), RGB, [tuple(map(int, c)) for c in STAINS])
    return s.select(*KEY, *[R(f"colour{k}", 5) for k in (1, 2, 3)])


@query(V.with_views("pixels", f"AND {_jzazbz()}, jch AS (SELECT image, x, y, j, sqrt(a*a + b*b) AS c, (degrees(atan2(b, a)) + 360.0 + 30.0) % 360 AS h FROM jab) SELECT image, x, y FROM jch WHERE j BETWEEN 0.004 AND 0.012 AND c BETWEEN 0.003 AND 0.02 AND h BETWEEN 20 AND 250"))
def colours_segmented(spark: SparkSession, d: str) -> DataFrame:
    """Pixels within ranges of lightness, colourfulness and hue."""
    return S.segment_colours(V.pixels(spark, d), RGB, (0.004, 0.012), (0.003, 0.02), (20, 250), rotation=30)


@query()
def dominant_circle_hues(spark: SparkSession, d: str) -> DataFrame:
    return S.dominant_hues(V.pixels(spark, d), RGB)


@query(
    V.with_views(
        "pixels",
        "AND lim AS (SELECT image, " + ", ".join(f"min(v{k}) AS a{k}, max(v{k}) AS b{k}" for k in (1, 2)) + " FROM pixels GROUP BY image), u AS (SELECT image, x, y, " + ", ".join(f"coalesce((v{k} - a{k})::DOUBLE / nullif(b{k} - a{k}, 0), 0) AS u{k}" for k in (1, 2)) + " FROM pixels JOIN lim USING (image)), w AS (SELECT *, coalesce(u1 / nullif(u1 + u2, 0), 0) AS p1, coalesce(u2 / nullif(u1 + u2, 0), 0) AS p2 FROM u)"
        " SELECT image, x, y, round(least(u1 * p1 * 1.0 + u2 * p2 * 0.0, 1), 6) + 0.0 AS r, round(least(u1 * p1 * 0.5 + u2 * p2 * 0.25, 1), 6) + 0.0 AS g, round(least(u1 * p1 * 0.0 + u2 * p2 * 1.0, 1), 6) + 0.0 AS b FROM w",
    )
)
def multichannel_colours(spark: SparkSession, d: str) -> DataFrame:
    """Two bands in their colours."""
    return P.multichannel_colours(V.pixels(spark, d), ["v1", "v2"], [(1.0, 0.5, 0.0), (0.0, 0.25, 1.0)]).select(*KEY, R("r"), R("g"), R("b"))


@query()
def tissue_rgb(spark: SparkSession, d: str) -> DataFrame:
    return Mk.tissue_rgb(V.pixels(spark, d), RGB)


@query()
def tissue_lightness_colourfulness(spark: SparkSession, d: str) -> DataFrame:
    mask, hull = Mk.tissue_lightness_colourfulness(V.pixels(spark, d), RGB)
    return mask.withColumn("kind", F.lit("mask")).unionByName(hull.withColumn("kind", F.lit("hull")))


@query()
def tissue_entropy(spark: SparkSession, d: str) -> DataFrame:
    return Mk.tissue_entropy(V.pixels(spark, d), RGB)


A_SQL = "SELECT image, x, y FROM pixels WHERE v1 > 60"
DISK = [(i, j) for j in range(-2, 3) for i in range(-2, 3) if i * i + j * j <= 4]


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return V.pixels(spark, d).where("v1 > 60").select(*KEY)


@query(V.with_views("pixels", f"AND f AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image) SELECT DISTINCT m.image, (m.x + i)::INT AS x, (m.y + j)::INT AS y FROM ({A_SQL}) m, (VALUES {', '.join(map(str, DISK))}) s(i, j), f WHERE f.image = m.image AND m.x + i >= 0 AND m.y + j >= 0 AND m.x + i < w AND m.y + j < h"))
def mask_dilated(spark: SparkSession, d: str) -> DataFrame:
    return Mk.dilate(_mask(spark, d), Mk.frames(V.pixels(spark, d)), 2).select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query(V.with_views("pixels", f"AND m AS ({A_SQL}) SELECT image, x, y FROM m WHERE (SELECT count(*) FROM m n WHERE n.image = m.image AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4"))
def mask_outline(spark: SparkSession, d: str) -> DataFrame:
    return P.outline(_mask(spark, d))


@query()
def mask_holes_filled(spark: SparkSession, d: str) -> DataFrame:
    return Mk.fill_holes(_mask(spark, d), Mk.frames(V.pixels(spark, d)))


@query()
def mask_hulls(spark: SparkSession, d: str) -> DataFrame:
    return Mk.hulls(P.components(_mask(spark, d))).drop("corners")


@query()
def mask_boxes_merged(spark: SparkSession, d: str) -> DataFrame:
    return Mk.box_mask(V.pixels(spark, d).where("v1 > 150").select(*KEY))


@query()
def mask_cleaned(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    return Mk.clean_mask(_mask(spark, d), Mk.frames(p), p, RGB, 0.01)


@query()
def mask_without_thin_parts(spark: SparkSession, d: str) -> DataFrame:
    return Mk.without_thin_parts(_mask(spark, d), 16)


@query(V.with_views("pixels", "AND top AS (SELECT image, max(v1)::DOUBLE AS top FROM pixels GROUP BY image), p AS (SELECT x, y, count(*) AS n, round(sum(v1 / top), 9) AS weight FROM pixels JOIN top USING (image) WHERE v1 > 0 GROUP BY x, y HAVING count(*) >= 2) SELECT x, y FROM p WHERE 2 * weight >= (SELECT max(weight) FROM p) - 1e-9"))
def consensus_mask(spark: SparkSession, d: str) -> DataFrame:
    """Places that several images are bright at."""
    return P.consensus_mask(V.pixels(spark, d), "v1")


@query()
def background_removed(spark: SparkSession, d: str) -> DataFrame:
    return Mk.remove_background(V.pixels(spark, d), "v1", 3)


@query()
def denoised(spark: SparkSession, d: str) -> DataFrame:
    return Mk.denoise(V.pixels(spark, d), "v1", rounds=30)

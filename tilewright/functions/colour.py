"""Colour spaces over columns. Each step is a projection of its own, so that no step's terms are repeated in the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.kernels import colour as K

EPS = K.EPS


def _dot(row: object, values: list[Column]) -> Column:
    total = F.lit(0.0)
    for k, v in zip(row, values, strict=True):
        total = total + F.lit(float(k)) * v
    return total


def _steps(df: DataFrame, steps: list, out: list[str], values: list[Column]) -> DataFrame:
    """The columns of ``df`` and those named ``out``: ``values`` taken through ``steps``, functions of lists of columns to lists of columns.

    The last step goes through a generator of one row: a filter on a colour would otherwise be pushed below all steps, with
    the terms of each repeated in the next one's.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in out]
    made = [v.alias(f"__s0_{i}") for i, v in enumerate(values)]
    df = df.select(*keep, *made)
    for k, step in enumerate(steps):
        now = step([F.col(f"__s{k}_{i}") for i in range(len(made))])
        if k == len(steps) - 1:
            return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(n) for v, n in zip(now, out, strict=True)]))))
        made = [v.alias(f"__s{k + 1}_{i}") for i, v in enumerate(now)]
        df = df.select(*keep, *made)
    raise ValueError("a conversion has a step at least")


def linear(v: Column) -> Column:
    """A part of sRGB in 0 to 1 without its gamma."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((F.greatest(v, F.lit(0.0)) + 0.055) / 1.055, F.lit(2.4)))


def gamma(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def _adapt(x: Column, f_l: float) -> Column:
    p = F.pow(F.lit(f_l / 100) * F.abs(x), F.lit(0.42))
    return 400.0 * F.signum(x) * p / (p + 27.13) + 0.1


def _forward(space: str) -> list:
    xyz = [lambda v: [linear(x) for x in v], lambda v: [_dot(row, v) for row in K.RGB_TO_XYZ]]
    if space == "HunterLab":

        def hunter(v: list[Column]) -> list[Column]:
            x, y, z = (a / float(w) for a, w in zip(v, K.HUNTER_WHITE, strict=True))
            return [F.sqrt(F.greatest(y, F.lit(EPS))), x - y, y - z]

        return [*xyz, hunter, lambda v: [v[0], K.HUNTER_K[0] * v[1] / v[0], K.HUNTER_K[1] * v[2] / v[0]]]
    if space == "JzAzBz":

        def pq(x: Column) -> Column:
            p = F.pow(F.greatest(x, F.lit(0.0)) / 10000.0, F.lit(K.PQ_N))
            return F.pow((K.PQ_C1 + K.PQ_C2 * p) / (1 + K.PQ_C3 * p), F.lit(K.PQ_P))

        return [
            *xyz,
            lambda v: [K.JZ_B * v[0] - (K.JZ_B - 1) * v[2], K.JZ_G * v[1] - (K.JZ_G - 1) * v[0], v[2]],
            lambda v: [_dot(row, v) for row in K.JZ_LMS],
            lambda v: [pq(x) for x in v],
            lambda v: [_dot(row, v) for row in K.JZ_IAB],
            lambda v: [(1 + K.JZ_D) * v[0] / (1 + K.JZ_D * v[0]) - K.JZ_D0, v[1], v[2]],
        ]
    if space != "CAM16UCS":
        raise ValueError(f"unknown colour space {space}")
    k = K.cam16_constants()
    chroma = (1.64 - 0.29 ** k["n"]) ** 0.73 * k["f_l"] ** 0.25

    def opponent(v: list[Column]) -> list[Column]:
        r, g, b = v
        light = F.pow(F.greatest(2 * r + g + b / 20 - 0.305, F.lit(0.0)) * float(k["n_bb"] / k["a_w"]), F.lit(float(K.C_SURROUND * k["z"])))
        return [100.0 * light, r - 12 * g / 11 + b / 11, (r + g - 2 * b) / 9, r + g + 21 * b / 20]

    def strength(v: list[Column]) -> list[Column]:
        light, p, q, total = v
        h = F.atan2(q, p)
        t = 50000 / 13 * K.N_C * float(k["n_bb"]) * (F.cos(h + 2) + 3.8) / 4 * F.sqrt(p * p + q * q) / total
        return [light, h, F.pow(F.greatest(t, F.lit(0.0)), F.lit(0.9)) * F.sqrt(light / 100) * float(chroma)]

    return [
        *xyz,
        lambda v: [_dot(row, v) for row in 100 * K.M16],
        lambda v: [_adapt(x * float(gain), float(k["f_l"])) for x, gain in zip(v, k["gain"], strict=True)],
        opponent,
        strength,
        lambda v: [1.7 * v[0] / (1 + 0.007 * v[0]) / 100, v[1], F.log(1 + 0.0228 * v[2]) / 0.0228 / 100],
        lambda v: [v[0], v[2] * F.cos(v[1]), v[2] * F.sin(v[1])],
    ]


def rgb_to_jab(df: DataFrame, bands: list[str], space: str = "CAM16UCS", out: tuple[str, str, str] = ("j", "a", "b")) -> DataFrame:
    """``df`` with lightness and two opponent parts of the colours of three bands of 0 to 255."""
    return _steps(df, _forward(space), list(out), [F.col(f"`{c}`") / 255.0 + EPS for c in bands])


def jab_to_rgb(df: DataFrame, parts: list[str], space: str = "CAM16UCS", out: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """The way back: ``df`` with sRGB of 0 to 1, which is cut at these ends."""
    back = lambda m: lambda v: [_dot(row, v) for row in m]
    inv = K.np.linalg.inv
    if space == "HunterLab":
        steps = [lambda v: [(v[1] * v[0] / K.HUNTER_K[0] + v[0] * v[0]) * float(K.HUNTER_WHITE[0]), v[0] * v[0], (v[0] * v[0] - v[2] * v[0] / K.HUNTER_K[1]) * float(K.HUNTER_WHITE[2])]]
    elif space == "JzAzBz":

        def unpq(v: Column) -> Column:
            p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / K.PQ_P))
            return 10000.0 * F.pow(F.greatest((K.PQ_C1 - p) / (K.PQ_C3 * p - K.PQ_C2), F.lit(0.0)), F.lit(1 / K.PQ_N))

        steps = [
            lambda v: [(v[0] + K.JZ_D0) / (1 + K.JZ_D - K.JZ_D * (v[0] + K.JZ_D0)), v[1], v[2]],
            back(inv(K.JZ_IAB)),
            lambda v: [unpq(x) for x in v],
            back(inv(K.JZ_LMS)),
            lambda v: [(v[0] + (K.JZ_B - 1) * v[2]) / K.JZ_B, v[1], v[2]],
            lambda v: [v[0], (v[1] + (K.JZ_G - 1) * v[0]) / K.JZ_G, v[2]],
        ]
    elif space == "CAM16UCS":
        k = K.cam16_constants()
        chroma = (1.64 - 0.29 ** k["n"]) ** 0.73 * k["f_l"] ** 0.25

        def polar(v: list[Column]) -> list[Column]:
            j = 100 * v[0]
            return [F.greatest(j / (1.7 - 0.007 * j), F.lit(EPS)) / 100, F.atan2(v[2], v[1]), (F.exp(2.28 * F.sqrt(v[1] * v[1] + v[2] * v[2])) - 1) / 0.0228]

        def size(v: list[Column]) -> list[Column]:
            light, h, m = v
            t = F.pow(m / (F.sqrt(light) * float(chroma)), F.lit(1 / 0.9))
            p2 = float(k["a_w"] / k["n_bb"]) * F.pow(light, F.lit(float(1 / (K.C_SURROUND * k["z"])))) + 0.305
            return [p2, F.cos(h), F.sin(h), t, 50000 / 13 * K.N_C * float(k["n_bb"]) * (F.cos(h + 2) + 3.8) / 4]

        def opponent(v: list[Column]) -> list[Column]:
            p2, c, s, t, f = v
            along = 23 * p2 * t / (23 * f + 11 * t * c + 108 * t * s)
            return [p2, along * c, along * s]

        def unadapt(x: Column) -> Column:
            return F.signum(x) * float(100 / k["f_l"]) * F.pow(27.13 * F.abs(x) / F.greatest(400 - F.abs(x), F.lit(EPS)), F.lit(1 / 0.42))

        steps = [
            polar,
            size,
            opponent,
            lambda v: [(460 * v[0] + x * v[1] + y * v[2]) / 1403 - 0.1 for x, y in ((451, 288), (-891, -261), (-220, -6300))],
            lambda v: [unadapt(x) / float(gain) for x, gain in zip(v, k["gain"], strict=True)],
            back(inv(K.M16) / 100),
        ]
    else:
        raise ValueError(f"unknown colour space {space}")
    steps += [back(inv(K.RGB_TO_XYZ)), lambda v: [F.least(F.greatest(gamma(x), F.lit(0.0)), F.lit(1.0)) for x in v]]
    return _steps(df, steps, list(out), [F.col(f"`{c}`") for c in parts])


def rgb_to_ihls(r: Column, g: Column, b: Column) -> Column:
    """struct(hue, luminance, saturation) of colours of 0 to 255, hue in radians; a grey has hue 0."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    size = F.sqrt(F.greatest(r * r + g * g + b * b - r * g - r * b - g * b, F.lit(0.0)))
    angle = F.acos(F.least(F.greatest(F.try_divide(r - g / 2 - b / 2, size), F.lit(-1.0)), F.lit(1.0)))
    hue = F.coalesce(F.when(b > g, 2 * 3.141592653589793 - angle).otherwise(angle), F.lit(0.0))
    return F.struct(hue.alias("hue"), (0.2126 * r + 0.7152 * g + 0.0722 * b).alias("luminance"), (F.greatest(r, g, b) - F.least(r, g, b)).alias("saturation"))


def polar(j: Column, a: Column, b: Column, rotation: float = 0.0) -> Column:
    """struct(j, c, h): lightness, colourfulness, and hue in degrees of 0 to 360, turned by ``rotation``."""
    h = F.pmod(F.degrees(F.atan2(b, a)) + 360.0 + rotation, F.lit(360.0))
    return F.struct(j.alias("j"), F.sqrt(a * a + b * b).alias("c"), h.alias("h"))

"""Colour spaces for arrays of colours: sRGB (0 to 1) to and from lightness and two opponent parts."""

from __future__ import annotations

import numpy as np

# sRGB and its white (D65, two degrees), CAM16, JzAzBz and Hunter Lab as published.
RGB_TO_XYZ = np.array([[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]])
WHITE = np.array([0.95045592705, 1.0, 1.08905775076])
M16 = np.array([[0.401288, 0.650173, -0.051461], [-0.250268, 1.204414, 0.045854], [-0.002079, 0.048952, 0.953127]])
L_A, Y_B, C_SURROUND, N_C, F_SURROUND = 64 / np.pi * 0.2, 20.0, 0.69, 1.0, 1.0
JZ_B, JZ_G, JZ_D, JZ_D0 = 1.15, 0.66, -0.56, 1.6295499532821566e-11
JZ_LMS = np.array([[0.41478972, 0.579999, 0.0146480], [-0.2015100, 1.120649, 0.0531008], [-0.0166008, 0.264800, 0.6684799]])
JZ_IAB = np.array([[0.5, 0.5, 0.0], [3.524000, -4.066708, 0.542708], [0.199076, 1.096799, -1.295875]])
PQ_C1, PQ_C2, PQ_C3, PQ_N, PQ_P = 3424 / 2**12, 2413 / 2**7, 2392 / 2**7, 2610 / 2**14, 1.7 * 2523 / 2**5
HUNTER_WHITE, HUNTER_K = np.array([0.9502, 1.0, 1.0882]), (1.7230, 0.6720)
SPACES = ("CAM16UCS", "JzAzBz", "HunterLab")
EPS = 2.220446049250313e-16


def cam16_constants() -> dict[str, float | np.ndarray]:
    """What CAM16 derives from its viewing conditions; the same for all colours."""
    k = 1 / (5 * L_A + 1)
    f_l = 0.2 * k**4 * 5 * L_A + 0.1 * (1 - k**4) ** 2 * (5 * L_A) ** (1 / 3)
    n = Y_B / 100
    white = M16 @ (100 * WHITE)
    d = np.clip(F_SURROUND * (1 - 1 / 3.6 * np.exp((-L_A - 42) / 92)), 0, 1)
    gain = d * 100 / white + 1 - d
    n_bb = 0.725 * (1 / n) ** 0.2
    adapted = _adapt(gain * white, f_l)
    return {"f_l": f_l, "n": n, "z": 1.48 + np.sqrt(n), "n_bb": n_bb, "gain": gain, "a_w": (adapted @ [2, 1, 1 / 20] - 0.305) * n_bb}


def _adapt(x: np.ndarray, f_l: float) -> np.ndarray:
    p = (f_l * np.abs(x) / 100) ** 0.42
    return 400 * np.sign(x) * p / (p + 27.13) + 0.1


def linear(rgb: np.ndarray) -> np.ndarray:
    return np.where(rgb <= 0.04045, rgb / 12.92, ((np.maximum(rgb, 0) + 0.055) / 1.055) ** 2.4)


def gamma(lin: np.ndarray) -> np.ndarray:
    return np.where(lin <= 0.0031308, lin * 12.92, 1.055 * np.maximum(lin, 0) ** (1 / 2.4) - 0.055)


def rgb_to_jab(rgb: np.ndarray, space: str = "CAM16UCS") -> np.ndarray:
    """Colours of sRGB in 0 to 1 as lightness and two opponent parts, on a scale of 0 to 1 but for JzAzBz."""
    xyz = linear(np.asarray(rgb, float) + EPS) @ RGB_TO_XYZ.T
    if space == "HunterLab":
        x, y, z = np.moveaxis(xyz / HUNTER_WHITE, -1, 0)
        root = np.sqrt(np.maximum(y, EPS))
        return np.stack([root, HUNTER_K[0] * (x - y) / root, HUNTER_K[1] * (y - z) / root], axis=-1)
    if space == "JzAzBz":
        x, y, z = np.moveaxis(xyz, -1, 0)
        lms = np.stack([JZ_B * x - (JZ_B - 1) * z, JZ_G * y - (JZ_G - 1) * x, z], axis=-1) @ JZ_LMS.T
        p = (np.maximum(lms, 0) / 10000) ** PQ_N
        iab = ((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p)) ** PQ_P @ JZ_IAB.T
        i = iab[..., 0]
        return np.stack([(1 + JZ_D) * i / (1 + JZ_D * i) - JZ_D0, iab[..., 1], iab[..., 2]], axis=-1)
    if space != "CAM16UCS":
        raise ValueError(f"unknown colour space {space}")
    k = cam16_constants()
    r, g, b = np.moveaxis(_adapt((100 * xyz @ M16.T) * k["gain"], k["f_l"]), -1, 0)
    p, q = r - 12 * g / 11 + b / 11, (r + g - 2 * b) / 9
    h = np.arctan2(q, p)
    light = 100 * (np.maximum(2 * r + g + b / 20 - 0.305, 0) * k["n_bb"] / k["a_w"]) ** (C_SURROUND * k["z"])
    t = 50000 / 13 * N_C * k["n_bb"] * (np.cos(h + 2) + 3.8) / 4 * np.hypot(p, q) / (r + g + 21 * b / 20)
    m = np.maximum(t, 0) ** 0.9 * np.sqrt(light / 100) * (1.64 - 0.29 ** k["n"]) ** 0.73 * k["f_l"] ** 0.25
    m = np.log(1 + 0.0228 * m) / 0.0228
    return np.stack([1.7 * light / (1 + 0.007 * light), m * np.cos(h), m * np.sin(h)], axis=-1) / 100


def jab_to_rgb(jab: np.ndarray, space: str = "CAM16UCS") -> np.ndarray:
    """The way back to sRGB; what lies outside of 0 to 1 is left as it is."""
    j, a, b = np.moveaxis(np.asarray(jab, float), -1, 0)
    if space == "HunterLab":
        y = j * j
        xyz = np.stack([a * j / HUNTER_K[0] + y, y, y - b * j / HUNTER_K[1]], axis=-1) * HUNTER_WHITE
    elif space == "JzAzBz":
        i = (j + JZ_D0) / (1 + JZ_D - JZ_D * (j + JZ_D0))
        p = np.maximum(np.stack([i, a, b], axis=-1) @ np.linalg.inv(JZ_IAB).T, 0) ** (1 / PQ_P)
        lms = 10000 * np.maximum((PQ_C1 - p) / (PQ_C3 * p - PQ_C2), 0) ** (1 / PQ_N)
        x, y, z = np.moveaxis(lms @ np.linalg.inv(JZ_LMS).T, -1, 0)
        x = (x + (JZ_B - 1) * z) / JZ_B
        xyz = np.stack([x, (y + (JZ_G - 1) * x) / JZ_G, z], axis=-1)
    elif space == "CAM16UCS":
        k = cam16_constants()
        j, a, b = 100 * j, 100 * a, 100 * b
        light, h = j / (1.7 - 0.007 * j), np.arctan2(b, a)
        m = (np.exp(0.0228 * np.hypot(a, b)) - 1) / 0.0228
        bright = np.sqrt(np.maximum(light, EPS) / 100)
        t = (m / k["f_l"] ** 0.25 / (bright * (1.64 - 0.29 ** k["n"]) ** 0.73)) ** (1 / 0.9)
        e_t = (np.cos(h + 2) + 3.8) / 4
        p2 = k["a_w"] * (np.maximum(light, EPS) / 100) ** (1 / (C_SURROUND * k["z"])) / k["n_bb"] + 0.305
        # The opponent parts lie along the hue: p = s cos h, q = s sin h, and t fixes s.
        c, s = np.cos(h), np.sin(h)
        f = 50000 / 13 * N_C * k["n_bb"] * e_t
        size = 23 * p2 * t / (23 * f + 11 * t * c + 108 * t * s)
        p, q = size * c, size * s
        rgb = np.stack([460 * p2 + 451 * p + 288 * q, 460 * p2 - 891 * p - 261 * q, 460 * p2 - 220 * p - 6300 * q], axis=-1) / 1403
        x = rgb - 0.1
        rgb = np.sign(x) * 100 / k["f_l"] * (27.13 * np.abs(x) / np.maximum(400 - np.abs(x), EPS)) ** (1 / 0.42)
        xyz = (rgb / k["gain"]) @ np.linalg.inv(M16).T / 100
    else:
        raise ValueError(f"unknown colour space {space}")
    return gamma(xyz @ np.linalg.inv(RGB_TO_XYZ).T)


def to_polar(jab: np.ndarray, rotation: float = 0.0) -> np.ndarray:
    """Lightness, colourfulness and hue in degrees of 0 to 360."""
    j, a, b = np.moveaxis(np.asarray(jab, float), -1, 0)
    return np.stack([j, np.hypot(a, b), (np.degrees(np.arctan2(b, a)) % 360 + rotation) % 360], axis=-1)


def from_polar(jch: np.ndarray, rotation: float = 0.0) -> np.ndarray:
    j, c, h = np.moveaxis(np.asarray(jch, float), -1, 0)
    h = np.radians(h - rotation)
    return np.stack([j, c * np.cos(h), c * np.sin(h)], axis=-1)


def mean_colour(rgb: np.ndarray) -> np.ndarray:
    """The colour of 0 to 255 in the middle of some others, as they are seen."""
    return 255 * np.clip(jab_to_rgb(rgb_to_jab(np.asarray(rgb, float) / 255).mean(axis=0)), 0, 1)


def hue_circle(lightness: float, colourfulness: float, n: int = 360, space: str = "JzAzBz") -> np.ndarray:
    """``n`` colours (0 to 255) of one lightness and colourfulness around the circle of hues."""
    jch = np.stack([np.full(n, lightness), np.full(n, colourfulness), np.arange(n) * 360 / n], axis=-1)
    return (255 * np.clip(jab_to_rgb(from_polar(jch), space), 0, 1)).astype(np.uint8)


def distinct_colours(colours: np.ndarray, n: int, space: str = "CAM16UCS") -> np.ndarray:
    """``n`` of some colours (0 to 255) as far apart as they come, each the farthest from those before; all in turn if too few."""
    colours = np.asarray(colours)
    jab = rgb_to_jab(colours / 255, space)
    near = np.full(len(jab), np.inf)
    out = [int(((jab - jab.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    while len(out) < min(n, len(jab)):
        near = np.minimum(near, ((jab - jab[out[-1]]) ** 2).sum(axis=1))
        out.append(int(near.argmax()))
    return colours[np.resize(out, n)]


def unmixing_matrix(stains: np.ndarray) -> np.ndarray:
    """(bands, stains): what optical densities are multiplied with to tell how much there is of each stain,
    colours of 0 to 255 in rows."""
    od = np.maximum(-np.log10(np.asarray(stains, float) / 255 + EPS), 0)
    unit = np.nan_to_num(od / np.linalg.norm(od + EPS, axis=1, keepdims=True))
    return np.linalg.pinv(unit)

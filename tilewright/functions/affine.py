"""3x3 matrices as row-major ARRAY<DOUBLE> columns, and points under them. Matrices map destination to source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(m: Column, r: int, c: int) -> Column:
    return F.get(m, F.lit(3 * r + c))


def matrix(*values: Column | float) -> Column:
    """Nine values, row by row."""
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def identity() -> Column:
    return matrix(1, 0, 0, 0, 1, 0, 0, 0, 1)


def matmul(a: Column, b: Column) -> Column:
    """a @ b."""
    return F.array(*[_at(a, r, 0) * _at(b, 0, c) + _at(a, r, 1) * _at(b, 1, c) + _at(a, r, 2) * _at(b, 2, c) for r in range(3) for c in range(3)])


def inverse(m: Column) -> Column:
    """The inverse by cofactors; null for a singular matrix."""
    e = [_at(m, i // 3, i % 3) for i in range(9)]
    a, b, c, d, ee, f, g, h, i = e
    det = a * (ee * i - f * h) - b * (d * i - f * g) + c * (d * h - ee * g)
    cof = [ee * i - f * h, c * h - b * i, b * f - c * ee, f * g - d * i, a * i - c * g, c * d - a * f, d * h - ee * g, b * g - a * h, a * ee - b * d]
    return F.when(det != 0, F.array(*[x / det for x in cof]))


def apply_xy(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of m @ [x, y, 1], divided by its third part; a zero there counts as the smallest step."""
    w = _at(m, 2, 0) * x + _at(m, 2, 1) * y + _at(m, 2, 2)
    w = F.when(w == 0, F.lit(2.220446049250313e-16)).otherwise(w)
    return F.struct(((_at(m, 0, 0) * x + _at(m, 0, 1) * y + _at(m, 0, 2)) / w).alias("x"), ((_at(m, 1, 0) * x + _at(m, 1, 1) * y + _at(m, 1, 2)) / w).alias("y"))


def warp_rigid(m: Column, x: Column, y: Column) -> Column:
    """Points follow the inverse of the stored matrix."""
    return apply_xy(inverse(m), x, y)


def scaled(m: Column, sx: Column, sy: Column) -> Column:
    """S m S^-1: the matrix of the same motion of an image scaled by sx and sy."""
    at = lambda r, c: _at(m, r, c)
    return F.array(at(0, 0), at(0, 1) * sx / sy, at(0, 2) * sx, at(1, 0) * sy / sx, at(1, 1), at(1, 2) * sy, at(2, 0) / sx, at(2, 1) / sy, at(2, 2))


def similarity(rotation: Column, scale: Column, tx: Column, ty: Column) -> Column:
    """Rotation, uniform scale and shift."""
    a, b = scale * F.cos(rotation), scale * F.sin(rotation)
    return matrix(a, -b, tx, b, a, ty, 0, 0, 1)


def padding(w: Column, h: Column, out_w: Column, out_h: Column) -> Column:
    """Centres an image in a larger frame."""
    return matrix(1, 0, -(out_w - w) / 2, 0, 1, -(out_h - h) / 2, 0, 0, 1)


def resize(w: Column, h: Column, out_w: Column, out_h: Column) -> Column:
    return matrix(w / out_w, 0, 0, 0, h / out_h, 0, 0, 0, 1)


def reflection(flip_x: Column, flip_y: Column, w: Column, h: Column) -> Column:
    """Mirrors x within 0..w-1 and y within 0..h-1 where asked for."""
    return matrix(
        F.when(flip_x, -1.0).otherwise(1.0), 0, F.when(flip_x, w - 1.0).otherwise(0.0), 0, F.when(flip_y, -1.0).otherwise(1.0), F.when(flip_y, h - 1.0).otherwise(0.0), 0, 0, 1
    )


def rotation_about_centre(angle: Column, w: Column, h: Column) -> Column:
    """Rotation about the middle pixel."""
    cx, cy, c, s = w / 2 - 0.5, h / 2 - 0.5, F.cos(angle), F.sin(angle)
    return matrix(c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy, 0, 0, 1)


def decompose(m: Column) -> Column:
    """struct(tx, ty, rotation, scale_x, scale_y, shear)."""
    rotation = F.atan2(_at(m, 1, 0), _at(m, 0, 0))
    return F.struct(
        _at(m, 0, 2).alias("tx"),
        _at(m, 1, 2).alias("ty"),
        rotation.alias("rotation"),
        F.sqrt(_at(m, 0, 0) * _at(m, 0, 0) + _at(m, 1, 0) * _at(m, 1, 0)).alias("scale_x"),
        F.sqrt(_at(m, 0, 1) * _at(m, 0, 1) + _at(m, 1, 1) * _at(m, 1, 1)).alias("scale_y"),
        (F.atan2(-_at(m, 0, 1), _at(m, 1, 1)) - rotation).alias("shear"),
    )


def corners(w: Column, h: Column) -> Column:
    """The corners of an image in order top left, top right, bottom right, bottom left."""
    zero = F.lit(0.0)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w * 1.0, zero), (w * 1.0, h * 1.0), (zero, h * 1.0))])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def polygon_area(points: Column) -> Column:
    """Area of a simple polygon, an array of struct(x, y), by the shoelace formula."""

    def area(ps: Column) -> Column:
        def term(p: Column, i: Column) -> Column:
            q = F.get(ps, (i + 1) % F.size(ps))
            return p["x"] * q["y"] - q["x"] * p["y"]

        return F.abs(F.aggregate(F.transform(ps, term), F.lit(0.0), lambda s, x: s + x)) / 2

    return let(points, area)


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Whether an odd number of edges is to the right of a point: strictly inside, for points off the edges."""

    def inside(ps: Column) -> Column:
        def crosses(p: Column, i: Column) -> Column:
            q = F.get(ps, (i + 1) % F.size(ps))
            spans = (p["y"] > y) != (q["y"] > y)
            return F.when(spans & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(spans, q["y"] - p["y"]).otherwise(1.0) + p["x"]), 1).otherwise(0)

        return F.aggregate(F.transform(ps, crosses), F.lit(0), lambda s, k: s + k) % 2 == 1

    return let(points, inside)

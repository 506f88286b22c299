"""Vectors, predicates and angles in two and three dimensions, as column expressions over doubles."""

from __future__ import annotations

from functools import reduce
from operator import add as _add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def vec(prefix: str, axes: str = "xy") -> Vec:
    """The columns ``<prefix>x``, ``<prefix>y``, ..."""
    return tuple(F.col(f"{prefix}{a}") for a in axes)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def divide(a: Vec, k) -> Vec:
    return tuple(x / k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(_add, [x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec):
    """A vector in three dimensions, the signed area in two."""
    if len(a) == 2:
        return a[0] * b[1] - a[1] * b[0]
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def max_dim(a: Vec) -> Column:
    return F.greatest(*a)


def min_coord(a: Vec, b: Vec) -> Vec:
    return tuple(F.least(x, y) for x, y in zip(a, b, strict=True))


def max_coord(a: Vec, b: Vec) -> Vec:
    return tuple(F.greatest(x, y) for x, y in zip(a, b, strict=True))


def quadrant(p: Vec, center: Vec) -> Column:
    """Number of the quadrant (octant) of ``p``: bit i is set where axis i is not below the centre."""
    return reduce(_add, [(x >= c).cast("bigint") * (1 << i) for i, (x, c) in enumerate(zip(p, center, strict=True))])


def offset_point(center: Vec, q: Column, by) -> Vec:
    """The centre moved by ``by`` on each axis, up where the quadrant's bit is set, else down."""
    return tuple(c + F.when(q.bitwiseAND(1 << i) != 0, by).otherwise(-by) for i, c in enumerate(center))


def out_of_box(p: Vec, center: Vec, half) -> Column:
    return reduce(lambda a, b: a | b, [(x < c - half) | (x > c + half) for x, c in zip(p, center, strict=True)])


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Twice the signed area; positive if counter-clockwise."""
    return cross(sub(b, a), sub(c, a))


def triangle_area_normalized(a: Vec, b: Vec, c: Vec) -> Column:
    return triangle_area(a, b, c) / (length(sub(b, a)) * length(sub(c, a)))


def counter_clockwise(a: Vec, b: Vec, c: Vec) -> Column:
    return triangle_area(a, b, c) > 0


def on_parabola(v: Vec) -> tuple[Column, Column, Column]:
    """The point lifted to the paraboloid."""
    return (v[0], v[1], dot(v, v))


def in_circle_det(a: Vec, b: Vec, c: Vec, p: Vec) -> Column:
    """Positive if ``p`` is inside the circle through counter-clockwise ``a``, ``b``, ``c``."""
    u, v, w = (on_parabola(sub(x, p)) for x in (a, b, c))
    return dot(cross(u, v), w)


def in_circle(a: Vec, b: Vec, c: Vec, p: Vec) -> Column:
    return in_circle_det(a, b, c, p) > 0


def in_circle_normalized(a: Vec, b: Vec, c: Vec, p: Vec) -> Column:
    u, v, w = (on_parabola(sub(x, p)) for x in (a, b, c))
    return in_circle_det(a, b, c, p) / (length(u) * length(v) * length(w))


def angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Angle at ``a`` between ``b`` and ``c``, in degrees."""
    u, v = sub(b, a), sub(c, a)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (length(u) * length(v))))))


def min_angle_below(a: Vec, b: Vec, c: Vec, degrees: float) -> Column:
    """Whether some angle of the triangle is below ``degrees``."""
    return F.least(angle(a, b, c), angle(b, c, a), angle(c, a, b)) < degrees


def skinny(a: Vec, b: Vec, c: Vec) -> Column:
    return min_angle_below(a, b, c, 30.0)


def obtuse_at(a: Vec, b: Vec, c: Vec) -> Column:
    """Whether the angle at ``a`` is above 90 degrees."""
    return dot(sub(b, a), sub(c, a)) < 0


def circumcenter(a: Vec, b: Vec, c: Vec) -> Vec:
    u, v = sub(b, a), sub(c, a)
    d = cross(u, v) * 2
    return (a[0] + (v[1] * dot(u, u) - u[1] * dot(v, v)) / d, a[1] + (u[0] * dot(v, v) - v[0] * dot(u, u)) / d)


def box_surface(low: Vec, high: Vec) -> Column:
    """Surface of an axis-parallel box."""
    x, y, z = sub(high, low)
    return (x * y + y * z + z * x) * 2


def in_box(p: Vec, low: Vec, high: Vec) -> Column:
    return reduce(lambda a, b: a & b, [(x >= lo) & (x <= hi) for x, lo, hi in zip(p, low, high, strict=True)])

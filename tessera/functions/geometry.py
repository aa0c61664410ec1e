"""Geometry as Column expressions: everything stays inside whole-stage code generation. Vectors are tuples of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COS_LIMIT

Vec = tuple[Column, ...]


def cols(names: str) -> Vec:
    """Columns named in a string, e.g. "ax ay az"."""
    return tuple(F.col(n) for n in names.split())


def over(a: Column | float, b: Column) -> Column:
    """a / b, null where b is 0 (sites on one spot or line have no direction)."""
    return a / F.nullif(b, F.lit(0.0))


def wrap(x: Column, length: Column | float) -> Column:
    """x moved by whole boxes into [0, length)."""
    return x - length * F.floor(x / length).cast("double")


def min_image(d: Column, length: Column | float) -> Column:
    """A displacement by its nearest image; exactly half a box stays as it is."""
    return F.when(d > length / 2, d - length).when(d < -length / 2, d + length).otherwise(d)


def displacement(a: Vec, b: Vec, box: tuple | None = None) -> Vec:
    """b - a, by nearest image if a box is given."""
    out = tuple(y - x for x, y in zip(a, b, strict=True))
    return tuple(min_image(d, side) for d, side in zip(out, box, strict=True)) if box else out


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def volume(box: Vec) -> Column:
    out = box[0]
    for side in box[1:]:
        out = out * side
    return out


def clamp_cos(c: Column) -> Column:
    """c within (-1, 1); null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(COS_LIMIT)), F.lit(-COS_LIMIT)))


def distance_derivative(disp: Vec) -> Vec:
    """disp / r, for the first end; the last end has its negative."""
    return scale(disp, over(F.lit(1.0), norm(disp)))


def cos_angle(u: Vec, v: Vec) -> Column:
    return clamp_cos(over(dot(u, v), norm(u) * norm(v)))


def angle(u: Vec, v: Vec) -> Column:
    """Degrees between the legs u and v, both from the centre."""
    return F.degrees(F.acos(cos_angle(u, v)))


def angle_derivatives(u: Vec, v: Vec) -> tuple[Vec, Vec]:
    """Gradients of the angle, in degrees, at the two ends, null where a leg has no length; the centre has the negative of their sum."""
    c = cos_angle(u, v)
    s = F.sqrt(1 - c * c)
    ru, rv = norm(u), norm(v)
    at_u = tuple(F.degrees(over(over(c * x, ru) - over(y, rv), ru * s)) for x, y in zip(u, v, strict=True))
    at_v = tuple(F.degrees(over(over(c * y, rv) - over(x, ru), rv * s)) for x, y in zip(u, v, strict=True))
    return at_u, at_v


def _normals(k: Vec, i: Vec, j: Vec, end: Vec, box: tuple | None) -> tuple[Vec, Vec, Vec, Vec, Vec]:
    first, centre, last = displacement(k, i, box), displacement(i, j, box), displacement(j, end, box)
    return first, centre, last, cross(first, centre), cross(centre, last)


def dihedral(k: Vec, i: Vec, j: Vec, end: Vec, box: tuple | None = None) -> Column:
    """Signed dihedral in degrees about the bond i-j; cis is 0, and looking along i-j, clockwise is positive."""
    _, _, last, p, q = _normals(k, i, j, end, box)
    size = F.degrees(F.acos(clamp_cos(over(dot(p, q), norm(p) * norm(q)))))
    return F.when(dot(p, last) < 0, -size).otherwise(size)


def dihedral_derivatives(k: Vec, i: Vec, j: Vec, end: Vec, box: tuple | None = None, radians: bool = False) -> tuple[Vec, Vec, Vec]:
    """Gradients of the dihedral, in degrees (or radians), at k, end and i; j has the negative of their sum.

    The end sites move the angle along the normals of their planes. Moving or turning the whole molecule leaves the
    angle alone, so the four gradients and their torques sum to zero; taking torques about j, i must balance k and end
    by how far each reaches along the central bond.
    """
    to_i, bond, to_end, plane_k, plane_end = _normals(k, i, j, end, box)
    length = norm(bond)
    unit = (lambda x: x) if radians else F.degrees
    at_k = tuple(unit(over(-length * x, dot(plane_k, plane_k))) for x in plane_k)
    at_end = tuple(unit(over(length * x, dot(plane_end, plane_end))) for x in plane_end)
    reach_k, reach_end = dot(to_i, bond) / dot(bond, bond), dot(to_end, bond) / dot(bond, bond)
    at_i = tuple(reach_end * b - (1 + reach_k) * a for a, b in zip(at_k, at_end, strict=True))
    return at_k, at_end, at_i


def stillinger_weber(r: Column, cutoff: Column | float, gamma: float) -> Column:
    """exp(gamma / (r - cutoff)) inside the cutoff, else 0."""
    return F.when(r < cutoff, F.exp(gamma / (r - cutoff))).otherwise(0.0)


def stillinger_weber_slope(r: Column, cutoff: Column | float, gamma: float) -> Column:
    return F.when(r < cutoff, -gamma / ((r - cutoff) * (r - cutoff)) * F.exp(gamma / (r - cutoff))).otherwise(0.0)

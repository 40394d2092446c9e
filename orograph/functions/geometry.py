"""Vectors, the WGS84 ellipsoid and mesh encodings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)

Vector = tuple[Column, Column, Column]


def ecef(lon: Column, lat: Column, h: Column) -> Vector:
    """Earth-centred metres from degrees and height."""
    lam, phi = F.radians(lon), F.radians(lat)
    n = F.lit(A) / F.sqrt(F.lit(1.0) - E2 * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + h) * F.sin(phi)


def minus(p: Vector, q: Vector) -> Vector:
    return p[0] - q[0], p[1] - q[1], p[2] - q[2]


def cross(p: Vector, q: Vector) -> Vector:
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def dot(p: Vector, q: Vector) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def norm(p: Vector) -> Column:
    return F.sqrt(dot(p, p))


def unit(p: Vector, least: float = 1e-8) -> Vector:
    """The vector at length 1; one that is shorter than ``least`` stays as it is."""
    n = norm(p)
    return tuple(F.when(n > least, c / n).otherwise(c) for c in p)


def oct_encode(n: Vector) -> tuple[Column, Column]:
    """A unit normal as two bytes on the octahedron."""
    total = F.abs(n[0]) + F.abs(n[1]) + F.abs(n[2])
    x, y = n[0] / total, n[1] / total
    sign = lambda v: F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    fx, fy = (F.lit(1.0) - F.abs(y)) * sign(x), (F.lit(1.0) - F.abs(x)) * sign(y)
    byte = lambda v: F.floor((F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v)) * 0.5 + 0.5) * 255.0 + 0.5).cast("long")
    return byte(F.when(n[2] < 0, fx).otherwise(x)), byte(F.when(n[2] < 0, fy).otherwise(y))


def quantize(v: Column, low: Column, high: Column) -> Column:
    """A value's place between two others in 0..32767; 0 where they are equal."""
    return F.when(high > low, F.least(F.lit(32767), F.greatest(F.lit(0), F.floor((v - low) / (high - low) * 32767.0 + 0.5)))).otherwise(F.lit(0)).cast("long")


#: The least cosine that is told from zero.
EPSILON = 2.220446049250313e-16


def occlusion_magnitude(p: Vector, centre: Vector) -> Column:
    """How far along the unit vector ``centre`` the eye has to be to see a point over the horizon; both in ellipsoid-scaled space.

    There the ellipsoid is the unit sphere. In the plane of both vectors let the
    point lie ``along`` the centre's direction and ``aside`` from it, at distance
    d from the origin. The line of sight touches the sphere on the far side of
    the point, at an angle of acos(1 / d) from it, so its tangent point is at
    that angle plus the one between the vectors. The tangent meets the direction
    at one over the sum's cosine, which is d² / (along - aside * sqrt(d² - 1)).
    A point inside the sphere counts as if it lay on it.
    """
    along, aside, square = dot(p, centre), norm(cross(p, centre)), dot(p, p)
    outside = square > 1.0
    tangent = F.sqrt(F.greatest(square - 1.0, F.lit(0.0)))
    reach = F.when(outside, square).otherwise(F.sqrt(square))
    shadow = along - aside * tangent
    return reach / F.when(shadow == 0, F.lit(EPSILON) * reach).otherwise(shadow)


def scaled(p: Vector) -> Vector:
    """ECEF divided by the ellipsoid's radii."""
    return p[0] / A, p[1] / A, p[2] / B

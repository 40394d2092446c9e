"""Web Mercator and transverse Mercator (UTM) on WGS84, both ways, as columns and as arrays.

Each formula is written once over the functions that it needs, which come from
Spark's columns or from numpy. The transverse one is the series in the third
flattening to its fourth power: exact to a millimetre within its zone and some
degrees beyond.
"""

from __future__ import annotations

from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from orograph.functions.geometry import A

NUMPY = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, exp=np.exp, log=np.log, sqrt=np.sqrt, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, atanh=np.arctanh, radians=np.radians, degrees=np.degrees
)
COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, sinh=F.sinh, cosh=F.cosh, exp=F.exp, log=F.log, sqrt=F.sqrt, asin=F.asin, atan=F.atan, atan2=F.atan2, atanh=F.atanh, radians=F.radians, degrees=F.degrees)

# Codes of coordinate systems, and the zones' scale and origin.
MERCATOR = 3857
UTM_NORTH, UTM_SOUTH, UTM_EUROPE = 32600, 32700, 25800
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_E = 2 * _N**0.5 / (1 + _N)


def mercator(m: SimpleNamespace, lon: Any, lat: Any) -> tuple[Any, Any]:
    """Metres from degrees on the sphere of the ellipsoid's larger radius."""
    return A * m.radians(lon), A * m.atanh(m.sin(m.radians(lat)))


def mercator_inverse(m: SimpleNamespace, x: Any, y: Any) -> tuple[Any, Any]:
    return m.degrees(x / A), m.degrees(2.0 * m.atan(m.exp(y / A))) - 90.0


def transverse(m: SimpleNamespace, zone: Any, south: Any, lon: Any, lat: Any) -> tuple[Any, Any]:
    """Metres from degrees in a zone of UTM; ``south`` is 1 for zones whose northings count from the pole, else 0."""
    phi, lam = m.radians(lat), m.radians(lon - (zone * 6.0 - 183.0))
    t = m.sinh(m.atanh(m.sin(phi)) - _E * m.atanh(_E * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(t * t + 1.0))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x, y = x + a * m.cos(2.0 * j * xi) * m.sinh(2.0 * j * eta), y + a * m.sin(2.0 * j * xi) * m.cosh(2.0 * j * eta)
    return EAST + SCALE * _RADIUS * x, SOUTH * south + SCALE * _RADIUS * y


def transverse_inverse(m: SimpleNamespace, zone: Any, south: Any, x: Any, y: Any) -> tuple[Any, Any]:
    xi0, eta0 = (y - SOUTH * south) / (SCALE * _RADIUS), (x - EAST) / (SCALE * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi, eta = xi - b * m.sin(2.0 * j * xi0) * m.cosh(2.0 * j * eta0), eta - b * m.cos(2.0 * j * xi0) * m.sinh(2.0 * j * eta0)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * m.sin(2.0 * j * chi)
    return zone * 6.0 - 183.0 + m.degrees(m.atan2(m.sinh(eta), m.cos(xi))), m.degrees(phi)


def zone_of(code: int) -> tuple[int, int] | None:
    """(zone, whether it counts from the south) of a UTM code."""
    for base, south in ((UTM_NORTH, 0), (UTM_SOUTH, 1), (UTM_EUROPE, 0)):
        if 1 <= code - base <= 60:
            return code - base, south
    return None


def known(code: int) -> bool:
    return code == MERCATOR or zone_of(code) is not None


def project(code: int, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of degrees to metres of a coordinate system."""
    return mercator(NUMPY, lon, lat) if code == MERCATOR else transverse(NUMPY, *zone_of(code), lon, lat)


def unproject(code: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mercator_inverse(NUMPY, x, y) if code == MERCATOR else transverse_inverse(NUMPY, *zone_of(code), x, y)


def project_columns(code: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Columns of degrees to metres, each row in its own coordinate system."""
    zone, south = (code % 100).cast("double"), F.when((code > UTM_SOUTH) & (code <= UTM_SOUTH + 60), 1.0).otherwise(0.0)
    plain, across = mercator(COLUMNS, lon, lat), transverse(COLUMNS, zone, south, lon, lat)
    return tuple(F.when(code == MERCATOR, p).otherwise(t) for p, t in zip(plain, across, strict=True))

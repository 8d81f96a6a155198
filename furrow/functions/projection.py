"""Map projections as Column arithmetic (WGS-84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.constants import WGS84_A, WGS84_F
from furrow.functions.rings import let

E2 = WGS84_F * (2 - WGS84_F)
ECC = math.sqrt(E2)
# Standard parallel of the global equal-area grid: 30 degrees.
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)


def _q(sin_phi: Column) -> Column:
    es = sin_phi * F.lit(ECC)
    return (F.lit(1.0) - E2) * (
        sin_phi / (F.lit(1.0) - es * es)
        - F.lit(1 / (2 * ECC)) * F.log((F.lit(1.0) - es) / (F.lit(1.0) + es))
    )


def _q_pole() -> float:
    return (1 - E2) * (1 / (1 - E2) - math.log((1 - ECC) / (1 + ECC)) / (2 * ECC))


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees -> metres on the cylindrical equal-area grid (EPSG:6933)."""
    x = F.radians(lon) * F.lit(WGS84_A * K0)
    y = _q(F.sin(F.radians(lat))) * F.lit(WGS84_A / (2 * K0))
    return x, y


def equal_area_point(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The same for use inside a lambda over ring points: the sine is computed once."""
    y = let(F.sin(F.radians(lat)), _q) * F.lit(WGS84_A / (2 * K0))
    return F.radians(lon) * F.lit(WGS84_A * K0), y


def equal_area_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres on EPSG:6933 -> degrees, by the authalic-latitude series."""
    beta = F.asin(y * F.lit(2 * K0 / WGS84_A / _q_pole()))
    e4, e6 = E2**2, E2**3
    phi = (
        beta
        + F.lit(E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(beta * 2)
        + F.lit(23 * e4 / 360 + 251 * e6 / 3780) * F.sin(beta * 4)
        + F.lit(761 * e6 / 45360) * F.sin(beta * 6)
    )
    return F.degrees(x / F.lit(WGS84_A * K0)), F.degrees(phi)


# Krueger series of the transverse Mercator projection, third flattening n.
_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
_UTM_SCALE, _UTM_EAST, _UTM_NORTH_SOUTH = 0.9996, 500000.0, 10000000.0


def _central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Degrees -> metres in a UTM zone."""
    phi = F.radians(lat)
    lam = F.radians(lon - _central_meridian(zone))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(
        F.atanh(F.sin(phi)) - F.lit(c) * F.atanh(F.lit(c) * F.sin(phi))
    )
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        y = y + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    k = F.lit(_UTM_SCALE * _RECT)
    north_shift = F.when(north, F.lit(0.0)).otherwise(F.lit(_UTM_NORTH_SOUTH))
    return x * k + _UTM_EAST, y * k + north_shift


def utm_inverse(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Metres in a UTM zone -> degrees."""
    k = F.lit(_UTM_SCALE * _RECT)
    north_shift = F.when(north, F.lit(0.0)).otherwise(F.lit(_UTM_NORTH_SOUTH))
    xi, eta = (y - north_shift) / k, (x - _UTM_EAST) / k
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi0 = xi0 - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        eta0 = eta0 - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * j))
    lam = F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.degrees(lam) + _central_meridian(zone), F.degrees(phi)

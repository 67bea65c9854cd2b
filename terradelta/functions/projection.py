"""WGS84 longitude and latitude, spherical Mercator and UTM, as column arithmetic.

UTM is the transverse Mercator of Krueger's series in the third flattening, to the
fourth order: below a millimetre within a zone.  Other reference systems are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixel import col

# The WGS84 ellipsoid, and scale and offsets of UTM.
A, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Krueger's coefficients: to the projection, back from it.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)


def zone_of(epsg: int) -> tuple[float, bool]:
    """Central meridian in degrees, and whether the zone is a southern one."""
    base = 32600 if 32601 <= epsg <= 32660 else 32700 if 32701 <= epsg <= 32760 else None
    if base is None:
        raise ValueError(f"EPSG:{epsg} isn't supported: 4326, 3857 and UTM zones of WGS84 are")
    return (epsg - base) * 6.0 - 183.0, base == 32700


def is_metric(epsg: int) -> bool:
    if epsg == 4326:
        return False
    if epsg != 3857:
        zone_of(epsg)
    return True


def _geographic_to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    middle, south = zone_of(epsg)
    phi, lam = F.radians(lat), F.radians(lon - middle)
    conformal = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(conformal, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
    up, out = xi, eta
    for j, a in enumerate(ALPHA, 1):
        up, out = up + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta), out + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EAST + SCALE * RADIUS * out, (SOUTH if south else 0.0) + SCALE * RADIUS * up


def _utm_to_geographic(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    middle, south = zone_of(epsg)
    xi, eta = (y - (SOUTH if south else 0.0)) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    up, out = xi, eta
    for j, b in enumerate(BETA, 1):
        up, out = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), out - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(out))
    # conformal to geodetic latitude: a fixed point whose error shrinks by ECC ** 2 a step
    q, phi = F.atanh(F.sin(chi)), chi
    for _ in range(6):
        phi = F.asin(F.tanh(q + ECC * F.atanh(ECC * F.sin(phi))))
    return middle + F.degrees(F.atan2(F.sinh(out), F.cos(up))), F.degrees(phi)


def to_geographic(x, y, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in a supported system."""
    x, y = col(x), col(y)
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return F.degrees(x / A), F.degrees(F.atan(F.sinh(y / A)))
    return _utm_to_geographic(x, y, epsg)


def from_geographic(lon, lat, epsg: int) -> tuple[Column, Column]:
    lon, lat = col(lon), col(lat)
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return A * F.radians(lon), A * F.atanh(F.sin(F.radians(lat)))
    return _geographic_to_utm(lon, lat, epsg)


def reproject(x, y, source: int, target: int) -> tuple[Column, Column]:
    return (col(x), col(y)) if source == target else from_geographic(*to_geographic(x, y, source), target)

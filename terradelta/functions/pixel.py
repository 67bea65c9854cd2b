"""Scalar expressions on pixels.  All are built-in columns, so they stay inside code generation."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalise(x, scale: float = 1.0) -> Column:
    """x / scale in 0..1; what isn't finite is 0."""
    x = col(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(clip(x / scale, 0.0, 1.0))


def rms(before: list, after: list) -> Column:
    return F.sqrt(reduce(add, [F.pow(col(a) - col(b), 2) for b, a in zip(before, after)]) / len(before))


def normalized_difference(x, y) -> Column:
    x, y = col(x), col(y)
    return F.when(F.abs(x + y) > EPSILON, clip((x - y) / (x + y), -1.0, 1.0)).otherwise(0.0)


def excess_green(r, g, b) -> Column:
    return clip((2 * col(g) - col(r) - col(b)) / 2, -1.0, 1.0)


#: Index name -> the bands it needs, in the order of its arguments.
INDICES = {"ndvi": ("nir", "red"), "ndbi": ("swir1", "nir"), "mndwi": ("green", "swir1"), "ndwi": ("green", "nir"), "exg": ("red", "green", "blue")}


def spectral_index(name: str, bands: dict[str, str]) -> tuple[Column | None, str]:
    """The index over a band map (name -> column), or None and why not."""
    name, have = name.lower(), {k.lower(): v for k, v in bands.items()}
    if name not in INDICES:
        return None, f"unknown index {name}"
    missing = [b for b in INDICES[name] if b not in have]
    if missing:
        return None, f"{name} needs {', '.join(missing)}"
    args = [have[b] for b in INDICES[name]]
    return (excess_green(*args) if name == "exg" else normalized_difference(*args)), ""


def index_rms(deltas: list) -> Column:
    """Root mean square of half the absolute index changes."""
    return F.sqrt(reduce(add, [F.pow(F.abs(col(d)) / 2, 2) for d in deltas]) / len(deltas))


def luminance(r, g, b) -> Column:
    return 0.2989 * col(r) + 0.5870 * col(g) + 0.1140 * col(b)


def margin(score, threshold) -> Column:
    """How far a score is above the threshold, as a share of what is left above it."""
    return clip((col(score) - col(threshold)) / F.greatest(1 - col(threshold), F.lit(EPSILON)), 0.0, 1.0)


def rounded(x, digits: int) -> Column:
    """Half to even on the scaled value."""
    return F.rint(col(x) * 10**digits) / 10**digits


def exact_rounded(x, digits: int) -> Column:
    """Rounds by the exact binary value to at least one digit: 2.675 at two digits is 2.67; exact ties go to even.

    Below one unit of the last digit the number format would judge the shortest decimal form, so half a unit decides there."""
    x, unit, half = col(x), float(f"1e-{digits}"), float(f"5e-{digits + 1}")
    up = F.abs(x) >= half if Decimal(half) > Decimal(f"5e-{digits + 1}") else F.abs(x) > half
    whole = F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")
    return F.when(F.abs(x) < unit, F.signum(x) * F.when(up, unit).otherwise(0.0)).otherwise(whole)


def utm_epsg(lon, lat) -> Column:
    zone = F.pmod(F.floor((col(lon) + 180) / 6), F.lit(60)) + 1
    return (F.when(col(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_world(row, c, affine: tuple) -> tuple[Column, Column]:
    a, b, x0, d, e, y0 = affine
    return a * col(c) + b * col(row) + x0, d * col(c) + e * col(row) + y0


def to_pixel(x, y, affine: tuple) -> tuple[Column, Column]:
    a, b, x0, d, e, y0 = affine
    det = a * e - b * d
    dx, dy = col(x) - x0, col(y) - y0
    return (a * dy - d * dx) / det + 0.0, (e * dx - b * dy) / det + 0.0  # no negative zero


def heat_rgba(s) -> list[Column]:
    """Red, green, blue and alpha of a score: blue to red, clear up to 0.1."""
    s = clip(col(s), 0.0, 1.0)
    byte = lambda x, top=255: F.floor(clip(x, 0.0, 1.0) * top).cast("int")
    return [byte((s - 0.2) / 0.8), byte(1 - F.abs(s - 0.5) * 2, 220), byte((0.6 - s) / 0.6), F.when(s > 0.1, byte(clip(s, 0.2, 0.8))).otherwise(0)]

"""Neighbourhoods on a full pixel grid: smoothing, gradient, morphology.

Separable filters run as window functions along rows and then columns, after the
few border pixels are mirrored, so each pass is one shuffle by row or by column."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_extent = lambda df: df.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def mirrored(df: DataFrame, axis: str, radius: int) -> DataFrame:
    """df and copies of the ``radius`` border pixels beyond each end of an axis (d c b a | a b c d)."""
    size = F.col({"row": "height", "col": "width"}[axis])
    at = F.col(axis)
    places = F.array(at, F.when(at < radius, -1 - at), F.when(at >= size - radius, 2 * size - 1 - at))
    return df.withColumn(axis, F.explode(F.filter(places, lambda x: x.isNotNull())))


def along(df: DataFrame, axis: str, value: str, weights: list[float], out: str) -> DataFrame:
    """The weighted sum of the neighbours of a column along an axis."""
    r = len(weights) // 2
    other = "row" if axis == "col" else "col"
    w = W.partitionBy(other).orderBy(axis)
    shifted = [k * (F.col(value) if i == r else F.lag(value, r - i).over(w) if i < r else F.lead(value, i - r).over(w)) for i, k in enumerate(weights) if k]
    size = F.col({"row": "height", "col": "width"}[axis])
    return mirrored(df, axis, r).withColumn(out, reduce(add, shifted)).where(F.col(axis).between(0, size - 1))


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(scores: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Scores blurred over valid pixels only: G(s * v) / G(v)."""
    if sigma <= 0:
        return scores
    w = gaussian_weights(sigma)
    v = F.col("valid").cast("double")
    x = scores.crossJoin(F.broadcast(_extent(scores))).withColumn("num", F.col("score") * v).withColumn("den", v)
    for axis in ("row", "col"):
        r = len(w) // 2
        win = W.partitionBy("col" if axis == "row" else "row").orderBy(axis)
        size = F.col({"row": "height", "col": "width"}[axis])
        total = lambda c: reduce(add, [k * (F.col(c) if i == r else F.lag(c, r - i).over(win) if i < r else F.lead(c, i - r).over(win)) for i, k in enumerate(w)])  # noqa: E731, B023
        x = mirrored(x, axis, r).withColumns({"n2": total("num"), "d2": total("den")}).where(F.col(axis).between(0, size - 1)).drop("num", "den").withColumnsRenamed({"n2": "num", "d2": "den"})
    return x.withColumn("score", F.when(F.col("valid") & (F.col("den") > 1e-6), F.round(F.col("num") / F.col("den"), 6)).otherwise(0.0)).select(*scores.columns)


def sobel(df: DataFrame, value: str, out: str = "gradient") -> DataFrame:
    """Gradient magnitude: smooth [1 2 1] / 4 across, difference [-1 0 1] / 2 along, both axes, root mean square."""
    x = df.crossJoin(F.broadcast(_extent(df)))
    flat, step = [0.25, 0.5, 0.25], [-0.5, 0.0, 0.5]
    x = along(x, "row", value, flat, "_sr")
    x = along(x, "col", "_sr", step, "_gx")
    x = along(x, "col", value, flat, "_sc")
    x = along(x, "row", "_sc", step, "_gy")
    return x.withColumn(out, F.round(F.sqrt((F.pow("_gx", 2) + F.pow("_gy", 2)) / 2), 6)).select(*df.columns, out)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def _spread(pixels: DataFrame, radius: int) -> DataFrame:
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in disk(radius)]))
    return pixels.select("row", "col", near.alias("d")).select((F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"))


def dilate(pixels: DataFrame, radius: int, grid: DataFrame) -> DataFrame:
    """Sparse (row, col) pixels grown by a disk, within the extent of grid."""
    return _spread(pixels, radius).distinct().crossJoin(F.broadcast(_extent(grid))).where("row >= 0 and col >= 0 and row < height and col < width").select("row", "col")


def erode(pixels: DataFrame, radius: int) -> DataFrame:
    """Pixels all of whose disk is set; beyond the extent counts as not set."""
    return _spread(pixels, radius).groupBy("row", "col").count().where(F.col("count") == len(disk(radius))).select("row", "col").join(pixels, ["row", "col"], "left_semi")


def opening(pixels: DataFrame, radius: int, grid: DataFrame) -> DataFrame:
    return pixels if radius <= 0 else dilate(erode(pixels, radius), radius, grid)


def closing(pixels: DataFrame, radius: int, grid: DataFrame) -> DataFrame:
    return pixels if radius <= 0 else erode(dilate(pixels, radius, grid), radius)


def _spline_taps(t: float) -> list[tuple[int, float]]:
    """Weights of the cubic B-spline coefficients at -1, 0, 1, 2 for a place t after 0."""
    return [(-1, (1 - t) ** 3 / 6), (0, (4 - 6 * t * t + 3 * t**3) / 6), (1, (1 + 3 * t + 3 * t * t - 3 * t**3) / 6), (2, t**3 / 6)]


def _spline_coefficients(df: DataFrame, values: list[str], reach: int = 12) -> DataFrame:
    """Cubic B-spline coefficients along both axes: the inverse filter falls by 0.27 a pixel, so 12 to each side leave 1e-7.  Null (invalid) counts as 0."""
    pole = math.sqrt(3) - 2
    w = [-6 * pole / (1 - pole * pole) * pole ** abs(i) for i in range(-reach, reach + 1)]
    x = df.crossJoin(F.broadcast(_extent(df)))
    for v in values:
        x = x.withColumn(f"_null_{v}", F.col(v).isNull()).withColumn(v, F.coalesce(v, F.lit(0.0)))
        for axis in ("row", "col"):
            x = along(x, axis, v, w, "_c").drop(v).withColumnRenamed("_c", v)
        x = x.withColumn(v, F.when(~F.col(f"_null_{v}"), F.col(v)))
    return x.select(*df.columns)


def shifted(df: DataFrame, values: list[str], d_row: float, d_col: float, method: str = "nearest") -> DataFrame:
    """out(i) = in(i - shift); a pixel whose source lies beyond the extent is null.  Taps are integer moves and one aggregate."""
    size = F.broadcast(_extent(df))
    if method == "cubic":
        df = _spline_coefficients(df, values)
    if method == "nearest":
        taps = [(math.floor(d_row + 0.5), math.floor(d_col + 0.5), 1.0)]
    else:
        r, c = math.floor(d_row), math.floor(d_col)
        fr, fc = d_row - r, d_col - c
        if method == "cubic":
            taps = [(r + 1 - m, c + 1 - n, wr * wc) for m, wr in _spline_taps(1 - fr) for n, wc in _spline_taps(1 - fc) if wr * wc > 0]
        else:
            taps = [(r + i, c + j, wr * wc) for i, wr in ((0, 1 - fr), (1, fr)) for j, wc in ((0, 1 - fc), (1, fc)) if wr * wc > 0]
    tap = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(j).alias("c"), F.lit(w).alias("w")) for i, j, w in taps]))
    moved = df.select("row", "col", *values, tap.alias("t")).select((F.col("row") + F.col("t.r")).alias("row"), (F.col("col") + F.col("t.c")).alias("col"), *[(F.col(v) * F.col("t.w")).alias(v) for v in values])
    total = moved.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), *[F.when(F.count(v) == len(taps), F.sum(v)).alias(v) for v in values]).where(F.col("n") == len(taps)).drop("n")
    return df.select("row", "col").join(total, ["row", "col"], "left").crossJoin(size).select("row", "col", *[F.round(v, 9).alias(v) for v in values])

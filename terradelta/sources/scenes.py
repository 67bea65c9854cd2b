"""Pixel relations: (row, col, b1..b3, a1..a3, valid), one row a pixel of a before/after pair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 3
SPLIT = "1998-06-01"


def order_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene of lineitem: a cell a part on a square-ish grid, a band a return flag, mean quantity before and after a date.

    Cells beyond the last part, and cells that lack a band at either date, have no data."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    early = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp")
    mean = lambda flag, when: F.avg(F.when((F.col("l_returnflag") == flag) & when, F.col("l_quantity"))) / 50
    bands = [mean(flag, when).alias(f"{side}{i}") for side, when in (("b", early), ("a", ~early)) for i, flag in enumerate("ANR", 1)]
    cells = items.groupBy(F.col("l_partkey").alias("cell")).agg(*bands)
    last = items.agg(F.max("l_partkey")).first()[0]
    last = -1 if last is None else last
    width = max(1, math.ceil(math.sqrt(last + 1)))
    grid = spark.range((last // width + 1) * width).select(F.col("id").alias("cell"), F.lit(width).alias("width"))
    names = [f"{s}{i}" for s in "ba" for i in range(1, BANDS + 1)]
    full = grid.join(cells, "cell", "left").select(F.floor(F.col("cell") / F.col("width")).cast("int").alias("row"), F.pmod("cell", "width").cast("int").alias("col"), *names)
    valid = F.lit(True)
    for n in names:
        valid = valid & F.col(n).isNotNull()
    return full.withColumn("valid", valid)


# Places (rows from, to, columns from, to; ends excluded) on a scene of 512 x 512.
STAYS, GONE, NEW, CONVERTED, SEASON, NO_DATA = (60, 100, 380, 440), (330, 390, 150, 210), ((100, 160, 120, 200), (220, 260, 330, 370)), (410, 460, 60, 110), (300, 420, 240, 380), (0, 32, 0, 32)


def synthetic_scene(spark: SparkSession, size: int = 512, shift: int = 0, noise: float = 0.008, season: bool = False, no_data: bool = False, converted: bool = False, road: bool = False, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A deterministic test pair in 0..1: ground, an unchanged building, two new ones and a demolished one; ``ref`` marks true change.

    Options: a field whose green fades (no true change), a corner without data, a building on a
    green place, a road at both dates, and another light on the after scene.  Noise is a hash of
    the place, so it doesn't depend on partitions."""
    k = size / 512
    box = lambda at, dc=0: F.col("row").between(int(at[0] * k), int(at[1] * k) - 1) & (F.col("col") - dc).between(int(at[2] * k), int(at[3] * k) - 1)
    base = spark.range(size * size).select((F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    rand = lambda s: (F.pmod(F.xxhash64("row", "col", F.lit(s)), F.lit(20001)) / 10000 - 1) * noise
    out = base
    for i in range(1, BANDS + 1):
        green = 0.25 if i == 2 else 0.0

        def ground(dc):
            hills = 0.35 + 0.05 * F.sin(F.col("row") / 37.0) + 0.05 * F.cos((F.col("col") - dc) / 23.0)
            return F.when(F.abs(F.col("row") - 256 * k - 0.2 * (F.col("col") - dc)) < 3 * k, 0.6).otherwise(hills) if road else hills

        before, after = ground(0), ground(shift if road else 0)
        if converted:
            before = F.when(box(CONVERTED), 0.25 + green).otherwise(before)
        if season:
            before = F.when(box(SEASON), 0.35 + green).otherwise(before)
            after = F.when(box(SEASON, shift), 0.35 + 0.2 * green).otherwise(after)
        before = F.when(box(STAYS) | box(GONE), 0.75).otherwise(before)
        built = box(STAYS, shift) | box(NEW[0], shift) | box(NEW[1], shift) | (box(CONVERTED, shift) if converted else F.lit(False))
        after = F.when(built, 0.8).otherwise(after)
        out = out.withColumn(f"b{i}", before + rand(i)).withColumn(f"a{i}", after * gain + offset + rand(10 + i))
    out = out.withColumn("valid", ~box(NO_DATA) if no_data else F.lit(True))
    return out.withColumn("ref", box(GONE) | box(NEW[0]) | box(NEW[1]) | (box(CONVERTED) if converted else F.lit(False)))


def sampled(pixels: DataFrame, height: int, width: int, side: int = 1024) -> DataFrame:
    """Every n-th pixel, by a filter alone, so that the longer side keeps at most ``side``: output i shows the pixel at floor((i + 1/2) step)."""
    step = max(1.0, max(height, width) / side)
    i = lambda c: F.ceil(F.col(c) / step - 0.5)
    stays = lambda c, size: (F.floor((i(c) + 0.5) * step) == F.col(c)) & (i(c) < math.floor(size / step + 1e-9))
    return pixels.where(stays("row", height) & stays("col", width))


def tile_grid(spark: SparkSession, width: int, height: int, tile: int) -> DataFrame:
    """The row-major tiles of a raster, cut at its edges."""
    rows, cols = -(-height // tile), -(-width // tile)
    at = spark.range(rows * cols).select((F.floor(F.col("id") / cols) * tile).cast("int").alias("row0"), (F.col("id") % cols * tile).cast("int").alias("col0"))
    return at.withColumn("h", F.least(F.lit(tile), height - F.col("row0"))).withColumn("w", F.least(F.lit(tile), width - F.col("col0")))

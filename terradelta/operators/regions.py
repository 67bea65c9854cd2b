"""Connected components, zonal statistics and region geometry."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P

TILE = 256
SPAN = 1 << 31


def _checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        import tempfile

        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def _steps(connectivity: int) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])


def _label_tile(connectivity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = (pdf["row"].to_numpy(np.int64) * SPAN + pdf["col"].to_numpy(np.int64)).tolist()
        up = {i: i for i in ids}

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in ids:
            for r, c in _steps(connectivity):
                j = i + r * SPAN + c
                if j in up:
                    a, b = root(i), root(j)
                    if a != b:
                        up[max(a, b)] = min(a, b)
        return pdf[["row", "col"]].assign(part=[root(i) for i in ids])

    return run


def components(pixels: DataFrame, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """(row, col, label): label is the first pixel of the component in scan order, as row * 2^31 + col.

    Tiles of bounded size are labelled on their own; parts that touch across a tile
    border are then joined by hooking to the least neighbour and contracting."""
    pixels = pixels.select("row", "col").distinct()
    tiled = pixels.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    parts = _checkpointed(tiled.groupBy("tr", "tc").applyInPandas(_label_tile(connectivity), "row int, col int, part long"))
    last = (F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1))
    border = parts.where(last)
    touch = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in _steps(connectivity)]))
    moved = border.select("row", "col", F.col("part").alias("a"), touch.alias("d")).select((F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"), "a")
    edges = _checkpointed(moved.join(border.withColumnRenamed("part", "b"), ["row", "col"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    to = None  # part -> root of the parts that touch another, a table of border parts only
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = _checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")))
        hop = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hook = _checkpointed(hook.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        to = hook if to is None else _checkpointed(to.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        left, right = hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = _checkpointed(edges.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if to is None:
        return parts.withColumnRenamed("part", "label")
    return parts.join(to, parts["part"] == to["node"], "left").select("row", "col", F.coalesce("to", "part").alias("label"))


def numbered(labels: DataFrame) -> DataFrame:
    """Adds number: 1, 2, 3 ... by the components' first pixels in scan order.

    The distinct labels are sorted in ranges; each takes its place in its range and the
    length of the ranges before it, so no task sees all of them."""
    labels = _checkpointed(labels)  # the sample of the ranges shouldn't find the components again
    ranged = _checkpointed(labels.select("label").distinct().repartitionByRange("label").withColumn("_range", F.spark_partition_id()))
    length = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = length.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy("label"))
    order = ranged.join(F.broadcast(before), "_range").select("label", (F.col("_before") + place).alias("number"))
    return labels.join(order, "label")


def keep_large(labels: DataFrame, least: int) -> DataFrame:
    """Labels of components of at least so many pixels."""
    return labels.join(labels.groupBy("label").count().where(F.col("count") >= least), "label", "left_semi")


def zonal(labels: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """label, n, and the mean of each column: one shuffle for all."""
    return labels.join(values, ["row", "col"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns])


def exposed_edges(labels: DataFrame) -> DataFrame:
    """label, row, col, side: pixel sides between a region and what isn't it."""
    sides = [("N", -1, 0), ("S", 1, 0), ("W", 0, -1), ("E", 0, 1)]
    near = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(r).alias("r"), F.lit(c).alias("c")) for s, r, c in sides]))
    faces = labels.select("label", "row", "col", near.alias("d")).select("label", "row", "col", F.col("d.side").alias("side"), (F.col("row") + F.col("d.r")).alias("nr"), (F.col("col") + F.col("d.c")).alias("nc"))
    same = labels.select(F.col("label"), F.col("row").alias("nr"), F.col("col").alias("nc"))
    return faces.join(same, ["label", "nr", "nc"], "left_anti").select("label", "row", "col", "side")


def shapes(labels: DataFrame, pixel: float = 0.5) -> DataFrame:
    """label, pixel_count, area, perimeter, compactness and centroid (in pixels), exact for shapes of whole pixels."""
    area = labels.groupBy("label").agg(F.count(F.lit(1)).alias("pixel_count"), F.round(F.avg(F.col("row") + 0.5), 6).alias("centre_row"), F.round(F.avg(F.col("col") + 0.5), 6).alias("centre_col"))
    rim = exposed_edges(labels).groupBy("label").agg((F.count(F.lit(1)) * pixel).alias("perimeter"))
    out = area.join(rim, "label").withColumn("area", F.col("pixel_count") * pixel * pixel)
    return out.withColumn("compactness", F.round(P.clip(4 * math.pi * F.col("area") / F.pow("perimeter", 2), 0.0, 1.0), 4))


#: The directed side of a cell, its cell to the right, by name: corner offsets from and to.
SIDES = {"N": ((0, 0), (0, 1)), "E": ((0, 1), (1, 1)), "S": ((1, 1), (1, 0)), "W": ((1, 0), (0, 0))}


def trace(cells: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings of corner points around (row, col) cells."""
    here = set(map(tuple, cells.tolist()))
    steps = {"N": (-1, 0), "E": (0, 1), "S": (1, 0), "W": (0, -1)}
    return trace_sides([(r, c, s) for r, c in here for s, (dr, dc) in steps.items() if (r + dr, c + dc) not in here])


def trace_sides(sides: list[tuple[int, int, str]]) -> list[list[tuple[int, int]]]:
    """Rings from the exposed sides (row, col, side) of cells; where cells meet at a corner only, rings turn so as not to cross."""
    go: dict[tuple, list] = {}
    for r, c, s in sides:
        (r0, c0), (r1, c1) = SIDES[s]
        go.setdefault((r + r0, c + c0), []).append((r + r1, c + c1))
    rings = []
    while go:
        start = min(go)
        ring, at, way = [start], start, (0, 0)
        while True:
            options = go[at]
            # the sharpest right turn keeps to the same cell
            nxt = min(options, key=lambda p: (-((way[0] * (p[1] - at[1])) - (way[1] * (p[0] - at[0])))) * -1 if len(options) > 1 else 0)
            options.remove(nxt)
            if not options:
                del go[at]
            way, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            if at == start:
                break
            ring.append(at)
        corner = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - p[0])]
        rings.append(corner)
    return rings


def ring_area(ring: list[tuple[int, int]]) -> float:
    """Signed: positive around cells, negative around holes."""
    return sum(c0 * r1 - c1 * r0 for (r0, c0), (r1, c1) in zip(ring, ring[1:] + ring[:1])) / 2


def polygons(labels: DataFrame) -> DataFrame:
    """label, n_rings, n_holes, n_corners, area_px and rings ([x, y] = [col, row] corners) of every region; only exposed sides reach Python."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = trace_sides(list(zip(pdf["row"].tolist(), pdf["col"].tolist(), pdf["side"].tolist())))
        areas = [ring_area(r) for r in rings]
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "n_rings": [len(rings)], "n_holes": [sum(a < 0 for a in areas)], "n_corners": [sum(map(len, rings))], "area_px": [float(sum(areas))], "rings": [[[[float(x), float(y)] for y, x in r] for r in rings]]})

    return exposed_edges(labels).groupBy("label").applyInPandas(run, "label long, n_rings long, n_holes long, n_corners long, area_px double, rings array<array<array<double>>>")


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = sorted(map(tuple, points.tolist()))
    if len(p) < 3:
        return np.array(p, float)

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def least_rectangle(points: np.ndarray) -> tuple[float, float]:
    """Width and length of the enclosing rectangle of least area, which has a side on the hull."""
    h = hull(points)
    side = np.diff(np.vstack([h, h[:1]]), axis=0)
    unit = side / np.linalg.norm(side, axis=1, keepdims=True)
    along, across = h @ unit.T, h @ np.stack([-unit[:, 1], unit[:, 0]])
    a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
    i = int((a * b).argmin())
    return float(min(a[i], b[i])), float(max(a[i], b[i]))


def rectangles(labels: DataFrame, pixel: float = 0.5) -> DataFrame:
    """label, width, length, extent, elongation of each region's least rotated rectangle; only rim pixels reach Python."""
    rim = exposed_edges(labels).select("label", "row", "col").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf[["row", "col"]].to_numpy()
        width, length = least_rectangle(np.concatenate([cells + d for d in ((0, 0), (0, 1), (1, 0), (1, 1))]))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "width": [round(width * pixel, 2)], "length": [round(length * pixel, 2)], "box": [width * length]})

    box = rim.groupBy("label").applyInPandas(run, "label long, width double, length double, box double")
    count = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return box.join(count, "label").select("label", "width", "length", F.round(F.col("n") / F.col("box"), 4).alias("extent"), F.round(F.col("length") / F.greatest("width", F.lit(1e-3)), 2).alias("elongation"))


def change_ids(regions: DataFrame) -> DataFrame:
    """change_id by area, largest first, then label.  Ranges of the order are numbered on their own, behind the lengths of those before."""
    order = [F.col("area").desc(), F.col("label")]
    ranged = _checkpointed(_checkpointed(regions).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    length = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = length.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    out = ranged.join(F.broadcast(before), "_range")
    return out.withColumn("change_id", F.format_string("CHG-%04d", F.col("_before") + place)).drop("_range", "_before")

"""Polygons as rings: simplification, intersection, spatial joins and metric attributes.

A polygon is an array of rings, a ring an array of [x, y] corners, closed without
repeating the first one.  Inside is what an odd number of rings surrounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import projection
from ..functions.pixel import to_world

RINGS = "array<array<array<double>>>"


def world_rings(rings, affine: tuple) -> Column:
    """Rings of pixel corners [x, y] in world units."""
    rings = F.col(rings) if isinstance(rings, str) else rings
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(*to_world(p[1], p[0], affine))))


def reprojected(rings, source: int, target: int) -> Column:
    rings = F.col(rings) if isinstance(rings, str) else rings
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(*projection.reproject(p[0], p[1], source, target))))


def _edges(ring: Column) -> Column:
    """Structs x0, y0, x1, y1 relative to the ring's first corner, which keeps sums exact far from the origin."""
    first = ring[0]
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct((p[0] - first[0]).alias("x0"), (p[1] - first[1]).alias("y0"), (q[0] - first[0]).alias("x1"), (q[1] - first[1]).alias("y1")))


def _ring_sum(rings: Column, term) -> Column:
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s + F.aggregate(_edges(r), F.lit(0.0), lambda t, e: t + term(e, r[0])))


def _cross(e: Column) -> Column:
    return e["x0"] * e["y1"] - e["x1"] * e["y0"]


def area(rings) -> Column:
    """Holes, which turn the other way, count negative."""
    return F.abs(_ring_sum(F.col(rings) if isinstance(rings, str) else rings, lambda e, _: _cross(e))) / 2


def centroid(rings) -> tuple[Column, Column]:
    rings = F.col(rings) if isinstance(rings, str) else rings
    total = _ring_sum(rings, lambda e, _: _cross(e))
    of = lambda a, b, i: F.try_divide(_ring_sum(rings, lambda e, first: (e[a] + e[b]) * _cross(e) + 3 * first[i] * _cross(e)), 3 * total)
    return of("x0", "x1", 0), of("y0", "y1", 1)


def _thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open line Douglas and Peucker keep."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    open_parts = [(0, len(points) - 1)]
    while open_parts:
        i, j = open_parts.pop()
        if j - i < 2:
            continue
        base, mid = points[j] - points[i], points[i + 1 : j] - points[i]
        length = np.hypot(*base)
        far = np.abs(base[0] * mid[:, 1] - base[1] * mid[:, 0]) / length if length else np.hypot(mid[:, 0], mid[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            open_parts += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def _sides(rings: list) -> np.ndarray:
    return np.concatenate([np.stack([r, np.roll(r, -1, 0)], 1) for r in rings]) if rings else np.zeros((0, 2, 2))


def _turn(a, b, c):
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def _crossed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which segments of q cross one segment p inside both."""
    a, b, c, d = p[0], p[1], q[:, 0], q[:, 1]
    return (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a[None]) * _turn(c, d, b[None]) < 0)


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of all ranges one after another: of which range each is, and the index."""
    return np.repeat(np.arange(len(count)), count), np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _parts(sizes: np.ndarray, most: int = 1 << 16):
    """Slices of a list whose sizes add up to at most `most`, or of one entry."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + most, "right")))
        yield slice(begin, end)
        begin = end


class _Flat:
    """Polygons of an Arrow array as flat corners; side k runs from corner k to corner next[k]."""

    def __init__(self, polygons: pa.ListArray):
        rings, points = polygons.values, polygons.values.values
        ring_at, point_at, value_at = (x.offsets.to_numpy() for x in (polygons, rings, points))
        if (np.diff(value_at) < 2).any():
            raise ValueError("a corner needs x and y")
        values = points.values.to_numpy(zero_copy_only=False)
        self.corners = np.stack([values[value_at[:-1]], values[value_at[:-1] + 1]], 1)
        first, last = point_at[:-1], point_at[1:] - 1
        full = np.flatnonzero(last >= first)
        self.next = np.arange(1, len(self.corners) + 1)
        self.next[last[full]] = first[full]
        self.low, self.high = np.minimum(self.corners, self.corners[self.next]), np.maximum(self.corners, self.corners[self.next])
        self.start, self.count = point_at[ring_at[:-1]], point_at[ring_at[1:]] - point_at[ring_at[:-1]]
        self.firsts, at = first[full], np.searchsorted(full, ring_at)  # rings without corners have no part in anything
        self.ring, self.rings = at[:-1], np.diff(at)


def shared(one: pa.ListArray, two: pa.ListArray) -> np.ndarray:
    """Whether the polygons of each row share a point; touching counts.

    They do if sides meet or a ring of one, which need not hang together with the
    others, starts inside the other.  All rows are judged together, about 2^16
    pairs of sides at a time, so memory doesn't grow with the product of two outlines."""
    a, b = _Flat(one), _Flat(two)
    met = np.zeros(len(one), bool)
    rows, sides = _spread(a.start, a.count)
    for part in _parts(b.count[rows]):
        row, s = rows[part], sides[part]
        row, s = row[~met[row]], s[~met[row]]
        of, t = _spread(b.start[row], b.count[row])
        row, s = row[of], s[of]
        near = np.ones(len(t), bool)
        for k in (0, 1):
            near &= (b.low[t, k] <= a.high[s, k]) & (b.high[t, k] >= a.low[s, k])
        row, s, t = row[near], s[near], t[near]
        p, q, u, v = a.corners[s], a.corners[a.next[s]], b.corners[t], b.corners[b.next[t]]
        met[row[(_turn(p, q, u) * _turn(p, q, v) <= 0) & (_turn(u, v, p) * _turn(u, v, q) <= 0)]] = True
    for x, y in ((a, b), (b, a)):
        left = np.flatnonzero(~met)
        rows, rings = _spread(x.ring[left], x.rings[left])
        rows = left[rows]
        for part in _parts(y.count[rows]):
            row, at = rows[part], x.corners[x.firsts[rings[part]]]
            of, t = _spread(y.start[row], y.count[row])
            (px, py), (x0, y0), (x1, y1) = at[of].T, y.corners[t].T, y.corners[y.next[t]].T
            beyond = ((y0 > py) != (y1 > py)) & (px < x0 + (py - y0) * (x1 - x0) / np.where(y1 == y0, 1, y1 - y0))
            met[row[np.bincount(of[beyond], minlength=len(row)) % 2 == 1]] = True
    return met


def simplified(rings: list, tolerance: float) -> list:
    """Rings with fewer corners, each within tolerance; the given rings if the result would cross itself or lose a ring."""
    out = []
    for r in rings:
        far = int(np.hypot(*(r - r[0]).T).argmax())
        line = np.concatenate([r, r[:1]])
        keep = np.append(_thin(line[: far + 1], tolerance)[:-1], _thin(line[far:], tolerance))[:-1]
        if keep.sum() < 3:
            return rings
        out.append(r[keep])
    sides = _sides(out)
    return rings if any(_crossed(x, sides[i + 1 :]).any() for i, x in enumerate(sides)) else out


def _plain(x) -> list:
    return [np.array([list(p) for p in r], float) for r in x] if x is not None else []


def simplify(polygons: DataFrame, tolerance: float, rings: str = "rings") -> DataFrame:
    if tolerance <= 0:
        return polygons

    @arrow_udf(RINGS)
    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [r.tolist() for r in simplified(_plain(x), tolerance)] for x in s.to_pylist()], pa.list_(pa.list_(pa.list_(pa.float64()))))

    return polygons.withColumn(rings, run(rings))


def _box(rings: str) -> list[Column]:
    flat = F.flatten(F.col(rings))
    of = lambda f, i: f(F.transform(flat, lambda p: p[i]))
    return [of(F.array_min, 0).alias("_w"), of(F.array_min, 1).alias("_s"), of(F.array_max, 0).alias("_e"), of(F.array_max, 1).alias("_n")]


def spatial_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float, rings: str = "rings") -> DataFrame:
    """(left_id, right_id) of polygons that share a point.

    Both sides are dealt to the grid cells their boxes cover, joined by cell, and a
    pair is judged once, in the cell of the lower-left corner of the boxes' overlap.
    So no pair is listed twice and nothing has to be deduplicated.  cell should be
    about the size of the larger polygons.  Both sides are shuffled by cell: a side
    that looks small as a file would be broadcast with all its copies, and the pairs,
    which may be far more than the rows, would be judged in as few tasks as the other
    side has parts."""

    def dealt(df, key, name):
        boxed = df.where(F.col(rings).isNotNull() & (F.size(F.flatten(rings)) > 0)).select(F.col(key).alias(name), F.col(rings).alias(f"{name}_r"), *_box(rings))
        span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        boxed = boxed.withColumn("cx", F.explode(span("_w", "_e"))).withColumn("cy", F.explode(span("_s", "_n")))
        return boxed.withColumnsRenamed({c: f"{name}{c}" for c in ("_w", "_s", "_e", "_n")})

    a, b = dealt(left, left_id, "_a"), dealt(right, right_id, "_b")
    west, south = F.greatest("_a_w", "_b_w"), F.greatest("_a_s", "_b_s")
    near = (west <= F.least("_a_e", "_b_e")) & (south <= F.least("_a_n", "_b_n")) & (F.floor(west / cell) == F.col("cx")) & (F.floor(south / cell) == F.col("cy"))

    @arrow_udf("boolean")
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(shared(x, y))

    return a.hint("merge").join(b, ["cx", "cy"]).where(near).where(share("_a_r", "_b_r")).select(F.col("_a").alias(left_id), F.col("_b").alias(right_id))


def context_hits(regions: DataFrame, layers: dict[str, DataFrame], key: str, cell: float) -> DataFrame:
    """regions with context_hits, the names of the layers a region meets joined by ';' in the layers' order, and hits, their number."""
    out = regions
    for i, (_, layer) in enumerate(layers.items()):
        numbered = layer.select(F.monotonically_increasing_id().alias("_layer"), "rings")
        met = spatial_pairs(regions, numbered, key, "_layer", cell).select(key).distinct().withColumn(f"_hit{i}", F.lit(True))
        out = out.join(met, key, "left")
    names = F.filter(F.array(*[F.when(F.col(f"_hit{i}"), n) for i, n in enumerate(layers)]) if layers else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return out.withColumn("context_hits", F.array_join(names, ";")).withColumn("hits", F.size(names)).drop(*[f"_hit{i}" for i in range(len(layers))])


def metric_attributes(polygons: DataFrame, epsg: int, rings: str = "rings") -> DataFrame:
    """Adds area_m2, centroid_x, centroid_y (scene units), centroid_lon, centroid_lat and projected_epsg.

    A scene in degrees is measured in the UTM zone of each polygon's place; the zones
    present are few, so each is one CASE branch of the plan."""
    x, y = centroid(rings)
    out = polygons.withColumns({"centroid_x": x, "centroid_y": y})
    if projection.is_metric(epsg):
        lon, lat = projection.to_geographic("centroid_x", "centroid_y", epsg)
        return out.withColumns({"centroid_lon": F.round(lon, 7), "centroid_lat": F.round(lat, 7), "area_m2": F.rint(area(rings) * 1000) / 1000, "projected_epsg": F.lit(epsg)})
    from ..functions.pixel import utm_epsg

    out = out.withColumns({"centroid_lon": F.round("centroid_x", 7), "centroid_lat": F.round("centroid_y", 7), "projected_epsg": utm_epsg("centroid_x", "centroid_y")})
    zones = [r[0] for r in out.select("projected_epsg").distinct().collect() if r[0] is not None]  # at most 120
    measured = F.lit(None).cast("double")
    for z in zones:
        measured = F.when(F.col("projected_epsg") == z, area(reprojected(rings, epsg, z))).otherwise(measured)
    return out.withColumn("area_m2", F.rint(measured * 1000) / 1000)

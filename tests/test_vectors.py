import json
import random
import sqlite3
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terradelta.operators import vectors
from terradelta.operators.regions import polygons
from terradelta.sinks import vectors as sinks

BOX = lambda x, y, w, h: [[[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


def table(spark, shapes, key):
    return spark.createDataFrame(list(enumerate(shapes)), f"{key} long, rings {vectors.RINGS}")


def test_spatial_join_equals_brute_force(spark):
    r = random.Random(3)
    some = lambda n: [BOX(r.randint(-20, 20), r.randint(-20, 20), r.randint(1, 9), r.randint(1, 9)) for _ in range(n)]
    a, b = some(40), some(30)
    got = sorted(map(tuple, vectors.spatial_pairs(table(spark, a, "i"), table(spark, [*b, None, []], "j"), "i", "j", 4.0).collect()))
    meet = lambda p, q: all(min(x[k] for x in p[0]) <= max(x[k] for x in q[0]) and min(x[k] for x in q[0]) <= max(x[k] for x in p[0]) for k in (0, 1))
    assert got == [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if meet(p, q)]


def test_pairs_of_small_files_are_judged_in_many_tasks(spark, tmp_path):
    spots = [BOX(x, y, 1, 1) for x in range(0, 200, 5) for y in range(0, 200, 5)]
    for k in "ij":
        table(spark, spots, k).coalesce(1).write.parquet(str(tmp_path / k))
    one, two = (spark.read.parquet(str(tmp_path / k)) for k in "ij")
    pairs = vectors.spatial_pairs(one, two, "i", "j", 4.0).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins tasks of less than 1 MB
    try:
        got = pairs.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.i, r.j) for r in got) == [(k, k) for k in range(len(spots))]
    assert len({r.task for r in got}) > 1


def test_many_pairs_are_judged_together(spark):
    one, two = (table(spark, [BOX(k % 20, k // 20, 30, 30) for k in range(n)], key).coalesce(1) for n, key in ((500, "i"), (400, "j")))
    began = time.time()
    assert vectors.spatial_pairs(one, two, "i", "j", 64.0).count() == 200_000
    assert time.time() - began < 14  # one call a pair takes about twice that


def test_rings_that_hang_apart_equal_brute_force(spark):
    r = random.Random(5)

    def ring():
        x, y = r.randint(-12, 12), r.randint(-12, 12)
        return [[x + r.randint(-6, 6), y + r.randint(-6, 6)] for _ in range(r.choice((1, 2, 3, 4, 7)))]

    sides = lambda shape: [(c, d) for ring in shape for c, d in zip(ring, ring[1:] + ring[:1])]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sign = lambda n: (n > 0) - (n < 0)

    def meet(a, b, c, d):
        apart = any(max(a[k], b[k]) < min(c[k], d[k]) or max(c[k], d[k]) < min(a[k], b[k]) for k in (0, 1))
        return not apart and sign(turn(a, b, c)) * sign(turn(a, b, d)) <= 0 and sign(turn(c, d, a)) * sign(turn(c, d, b)) <= 0

    def within(p, shape):  # a ray to the east; an upward side is crossed if p is left of it
        return sum((c[1] > p[1]) != (d[1] > p[1]) and (turn(c, d, p) > 0) == (d[1] > c[1]) for c, d in sides(shape)) % 2 == 1

    def share(p, q):
        return any(meet(*s, *t) for s in sides(p) for t in sides(q)) or any(within(x[0], q) for x in p) or any(within(x[0], p) for x in q)

    shapes = [([ring() for _ in range(r.randint(1, 3))], [ring() for _ in range(r.randint(1, 3))]) for _ in range(2000)]
    one, two = (pa.array(x, pa.list_(pa.list_(pa.list_(pa.float64())))) for x in zip(*shapes))
    want = [share(p, q) for p, q in shapes]
    assert vectors.shared(one, two).tolist() == want and 0 < sum(want) < len(want)
    assert vectors.shared(one.slice(9, 50), two.slice(9, 50)).tolist() == want[9:59]
    far = BOX(50, 50, 1, 1)[0]
    got = vectors.spatial_pairs(table(spark, [[far, BOX(4, 4, 1, 1)[0]], [far]], "i"), table(spark, [BOX(0, 0, 60, 20)], "j"), "i", "j", 16.0).collect()
    assert [tuple(x) for x in got] == [(0, 0)]


def test_outlines_of_many_corners_are_judged_in_parts():
    angles = np.arange(600) * 2 * np.pi / 600
    circle = lambda size: (np.stack([np.cos(angles), np.sin(angles)], 1) * size).tolist()
    kind = pa.list_(pa.list_(pa.list_(pa.float64())))
    one = pa.array([[circle(9)], [circle(9), circle(8)], [circle(9)], None, [[]]], kind)
    assert vectors.shared(one, pa.array([[circle(5)]] * 2 + [[[[8.9, 0.0], [20.0, 1.0], [20.0, -1.0]]]] + [[circle(5)]] * 2, kind)).tolist() == [True, False, True, False, False]
    assert vectors.shared(one.slice(0, 0), one.slice(0, 0)).tolist() == []


def test_context_hits(spark):
    regions = table(spark, [BOX(0, 0, 2, 2), BOX(10, 10, 1, 1), BOX(50, 50, 1, 1)], "label")
    ring = [[[0.0, 0.0], [30.0, 0.0], [30.0, 30.0], [0.0, 30.0]], [[5.0, 5.0], [25.0, 5.0], [25.0, 25.0], [5.0, 25.0]]]
    layers = {"parks": table(spark, [BOX(1, 1, 1, 1), BOX(0, 0, 1, 1)], "k"), "ring": table(spark, [ring], "k")}
    got = {r.label: (r.context_hits, r.hits) for r in vectors.context_hits(regions, layers, "label", 5.0).collect()}
    assert got == {0: ("parks;ring", 2), 1: ("", 0), 2: ("", 0)}


def test_simplify_keeps_within_tolerance(spark):
    stairs = [[[float(i), float(j)] for k in range(10) for i, j in ((k, k), (k + 1, k))] + [[10.0, 10.0], [0.0, 10.0]]]
    out = vectors.simplify(table(spark, [stairs, BOX(0, 0, 1, 1), None], "k"), 0.8).orderBy("k").collect()
    assert len(out[0].rings[0]) < 8 and out[1].rings == BOX(0, 0, 1, 1) and out[2].rings is None
    assert vectors.simplified([np.array(BOX(0, 0, 1, 1)[0])], 5.0)[0].shape == (4, 2)


def test_area_and_centroid_with_hole(spark):
    cells = [(1, i, j) for i in range(5) for j in range(6) if (i, j) != (2, 3)] + [(2, 9, 9), (2, 10, 10)]
    shape = polygons(spark.createDataFrame(cells, "label long, row int, col int")).withColumn("rings", vectors.world_rings("rings", (0.5, 0, 500000, 0, -0.5, 4500000)))
    got = {r.label: r for r in vectors.metric_attributes(shape, 32633).collect()}
    assert got[1].area_m2 == pytest.approx(29 * 0.25) and got[2].area_m2 == pytest.approx(0.5)
    assert got[1].centroid_x == pytest.approx(500000 + 0.5 * np.mean([j + 0.5 for a, i, j in cells if a == 1]))
    assert got[1].centroid_lon == pytest.approx(15, abs=1e-3)


def test_degrees_are_measured_in_metres(spark):
    shape = table(spark, [BOX(15, 45, 1e-3, 1e-3)], "k")
    a = vectors.metric_attributes(shape, 4326).first()
    assert a.projected_epsg == 32633 and a.area_m2 == pytest.approx(78.85 * 111.14, rel=5e-3)


def test_vector_files(spark, tmp_path):
    cells = [(1, i, j) for i in range(5) for j in range(6) if (i, j) != (2, 3)] + [(2, 9, 9), (2, 10, 10)]
    shape = polygons(spark.createDataFrame(cells, "label long, row int, col int")).withColumn("rings", vectors.world_rings("rings", (0.5, 0, 500000, 0, -0.5, 4500000))).orderBy("label")
    assert sinks.write_geojson(shape, str(tmp_path / "a.geojson"), epsg=32633) == 2
    found = json.load(open(tmp_path / "a.geojson"))["features"]
    assert [f["geometry"]["type"] for f in found] == ["Polygon", "MultiPolygon"] and len(found[0]["geometry"]["coordinates"]) == 2
    assert found[0]["properties"]["n_holes"] == 1
    assert sinks.write_geojson(shape.limit(0), str(tmp_path / "none.geojson")) == 0
    assert json.load(open(tmp_path / "none.geojson"))["features"] == []
    back = sinks.read_geojson(spark, str(tmp_path / "a.geojson")).select(F.size("rings")).collect()
    assert [r[0] for r in back] == [2, 2]
    assert sinks.write_geopackage(shape, str(tmp_path / "a.gpkg"), 32633) == 2
    db = sqlite3.connect(tmp_path / "a.gpkg")
    assert db.execute("SELECT label, substr(geom, 1, 2) FROM change_polygons").fetchall() == [(1, b"GP"), (2, b"GP")]
    assert db.execute("SELECT min_x, srs_id FROM gpkg_contents").fetchone() == (500000.0, 32633)
    assert all(json.loads(r.value)["geometry"]["type"] == "Polygon" for r in sinks.geojson_lines(shape, epsg=32633).collect())


def test_layers_come_in_the_scenes_system(spark, tmp_path):
    square = [[[500010.0, 4500000.0], [500030.0, 4500000.0], [500030.0, 4500020.0], [500010.0, 4500020.0]], [[500015.0, 4500005.0], [500015.0, 4500010.0], [500020.0, 4500010.0]]]
    df = spark.createDataFrame([("one", square), ("two", [square[0]])], "name string, rings array<array<array<double>>>")
    sinks.write_geopackage(df, str(tmp_path / "a.gpkg"), 32633)
    sinks.write_geojson(df, str(tmp_path / "a.geojson"), epsg=32633)
    for name in ("a.gpkg", "a.geojson"):
        got = sinks.read_layer(spark, str(tmp_path / name), 32633).collect()
        assert sorted(len(r.rings) for r in got) == [1, 2]
        for r in got:
            assert sorted((round(x, 3), round(y, 3)) for x, y in r.rings[0]) == sorted(map(tuple, square[0]))
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::27700"}}, "features": []}')
    with pytest.raises(ValueError):
        sinks.read_layer(spark, str(tmp_path / "b.geojson"), 32633)


def test_viewer_holds_all_regions(spark, tmp_path):
    from terradelta.sinks import pictures

    rows = spark.range(21000).selectExpr("concat('CHG-', id) change_id", "'Low' severity_tier", "'unknown' type_tag", "double(id) area_m2", "0.5 confidence", "'' review_reasons", "array(array(array(0d, 0d), array(1d, 0d), array(1d, 1d))) rings")
    assert pictures.viewer(rows, dict.fromkeys(("before", "after", "heat"), b"x"), 4, 4, str(tmp_path / "v.html")) == 21000
    assert (tmp_path / "v.html").read_text().count('"change_id"') == 21000

"""Region tables as GeoJSON, GeoPackage and CSV.

``geojson_lines`` and CSV are written by the executors.  One-file formats are streamed
through the driver a partition at a time, so its memory doesn't grow with the table.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projection
from ..operators.vectors import reprojected


def ring_signed(ring: list) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


def _holds(ring: list, x: float, y: float) -> bool:
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
            odd = not odd
    return odd


def nested(rings: list) -> list[list]:
    """Polygons of one outer ring (counter-clockwise) and its holes (clockwise), closed.  A hole turns the other way than the largest ring."""
    rings = [list(map(tuple, r)) for r in rings or () if len(r) > 2]
    if not rings:
        return []
    way = ring_signed(max(rings, key=lambda r: abs(ring_signed(r)))) > 0
    outer = sorted((r for r in rings if (ring_signed(r) > 0) == way), key=lambda r: abs(ring_signed(r)))
    out = {id(r): [r] for r in outer}
    for hole in rings:
        if (ring_signed(hole) > 0) == way:
            continue
        (x0, y0), (x1, y1) = hole[:2]
        # a place just inside the hole's first side, which lies within its outer ring
        nx, ny = (x0 + x1) / 2 + (y1 - y0) * 1e-6 * (1 if way else -1), (y0 + y1) / 2 - (x1 - x0) * 1e-6 * (1 if way else -1)
        host = next((r for r in outer if _holds(r, nx, ny)), outer[-1])
        out[id(host)].append(hole)
    turned = lambda r, up: r if (ring_signed(r) > 0) == up else r[::-1]
    return [[(lambda r: r + r[:1])(turned(r, i == 0)) for i, r in enumerate(p)] for p in out.values()]


def geometry(rings: list) -> dict | None:
    parts = nested(rings)
    if not parts:
        return None
    return {"type": "Polygon", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPolygon", "coordinates": parts}


def _plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else value.asDict(True) if hasattr(value, "asDict") else value


def _features(df: DataFrame, rings: str, epsg: int | None) -> Iterator[tuple[dict, list]]:
    if epsg not in (None, 4326):
        df = df.withColumn(rings, reprojected(rings, epsg, 4326))
    for row in df.toLocalIterator():
        row = row.asDict()
        shape = row.pop(rings)
        yield {k: _plain(v) for k, v in row.items()}, shape


def write_geojson(df: DataFrame, path: str, rings: str = "rings", epsg: int | None = None) -> int:
    """One FeatureCollection in longitude and latitude; no rows make an empty one."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for n, (properties, shape) in enumerate(_features(df, rings, epsg), 1):
            f.write(("," if n > 1 else "") + "\n" + json.dumps({"type": "Feature", "properties": properties, "geometry": geometry(shape)}, ensure_ascii=False))
        f.write("\n]}\n")
    return n


def geojson_lines(df: DataFrame, rings: str = "rings", epsg: int | None = None) -> DataFrame:
    """One column, value: a feature a row, for df.write.text, at any size.

    All rings go in one polygon; use it for regions without diagonal parts, or the one-file writer."""
    if epsg not in (None, 4326):
        df = df.withColumn(rings, reprojected(rings, epsg, 4326))
    closed: Column = F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))
    properties = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != rings])
    shape = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def write_csv(df: DataFrame, path: str, rings: str = "rings") -> None:
    """A folder of parts with header; attributes only."""
    df.drop(rings).write.mode("overwrite").option("header", True).csv(path)


def wkb(rings: list) -> bytes | None:
    parts = nested(rings)
    if not parts:
        return None
    one = lambda p: struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *q[:2]) for q in r) for r in p)
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(one, parts))


def write_geopackage(df: DataFrame, path: str, epsg: int, layer: str = "change_polygons", rings: str = "rings") -> int:
    """A GeoPackage of one layer, in the scene's own system."""
    if os.path.exists(path):
        os.remove(path)
    kinds = {f.name: {"bigint": "INTEGER", "int": "MEDIUMINT", "smallint": "SMALLINT", "double": "REAL", "float": "FLOAT", "boolean": "BOOLEAN"}.get(f.dataType.simpleString(), "TEXT") for f in df.schema if f.name != rings}
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    db = sqlite3.connect(path)
    with db:
        # Fixed values of the GeoPackage 1.3 format.
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("PRAGMA user_version = 10300")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        for code, org in ((-1, "NONE"), (0, "NONE"), (epsg, "EPSG")):
            db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (f"{org}:{code}", code, org, code))
        columns = "".join(f", {quoted(c)} {k}" for c, k in kinds.items())
        db.execute(f"CREATE TABLE {quoted(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom MULTIPOLYGON{columns})")
        box, n = [None] * 4, 0
        for properties, shape in _features(df, rings, None):
            raw, n = wkb(shape), n + 1
            if raw is not None:
                xs, ys = [p[0] for r in shape for p in r], [p[1] for r in shape for p in r]
                here = [min(xs), min(ys), max(xs), max(ys)]
                box = here if box[0] is None else [min(box[0], here[0]), min(box[1], here[1]), max(box[2], here[2]), max(box[3], here[3])]
                raw = struct.pack("<2sBBi4d", b"GP", 0, 3, epsg, here[0], here[2], here[1], here[3]) + raw
            values = [json.dumps(v) if isinstance(v, (list, dict)) else v for v in properties.values()]
            db.execute(f"INSERT INTO {quoted(layer)} (geom{''.join(', ' + quoted(c) for c in properties)}) VALUES (?{', ?' * len(values)})", [raw, *values])
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *box, epsg))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", (layer, epsg))
    db.close()
    return n


def _unwrapped(blob: bytes | None) -> list | None:
    """Rings, opened, of a GeoPackage polygon; None for other shapes."""
    if not blob:
        return None
    at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]

    def number(form, size):
        nonlocal at
        got = struct.unpack_from(order + form, blob, at)
        at += size
        return got

    rings, left = [], 1
    while left:
        order = "<" if blob[at] else ">"
        at += 1
        kind = number("I", 4)[0]
        dims, kind = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3), kind % 1000
        if kind == 6:
            left += number("I", 4)[0] - 1
            continue
        if kind != 3:
            return None
        for _ in range(number("I", 4)[0]):
            n = number("I", 4)[0]
            flat = number(f"{n * dims}d", 8 * n * dims)
            rings.append([[flat[i], flat[i + 1]] for i in range(0, n * dims, dims)][:-1])
        left -= 1
    return rings


def read_geopackage(spark, path: str) -> DataFrame:
    """rings and epsg of each polygon of a GeoPackage's layers; the file is read where Spark puts it, one task a file."""

    def run(batches):
        import tempfile

        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
                    f.write(raw)
                    f.flush()
                    db = sqlite3.connect(f.name)
                    for layer, column, epsg in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall():
                        cursor = db.execute(f'SELECT "{column}" FROM "{layer}"')
                        while rows := cursor.fetchmany(1000):
                            found = [r for (blob,) in rows if (r := _unwrapped(blob))]
                            yield pd.DataFrame({"rings": found, "epsg": [epsg] * len(found)})
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "rings array<array<array<double>>>, epsg int")


def read_layer(spark, path: str, epsg: int) -> DataFrame:
    """rings of a GeoJSON or GeoPackage layer in the system ``epsg``.  GeoJSON is in longitude and latitude unless its ``crs`` names another."""
    if path.lower().endswith(".gpkg"):
        layer = read_geopackage(spark, path)
        sources = [r[0] for r in layer.select("epsg").distinct().collect()]  # one a layer of the file
    else:
        named = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.crs.properties.name").alias("n")).first()
        code = re.search(r"EPSG:+(\d+)$", (named and named.n) or "")
        sources = [int(code[1]) if code else 4326]
        layer = read_geojson(spark, path).withColumn("epsg", F.lit(sources[0]))
    for s in sources:
        projection.is_metric(s)  # refuses a system that isn't supported
    moved = F.col("rings")
    for s in sources:
        if s != epsg:
            moved = F.when(F.col("epsg") == s, reprojected("rings", s, epsg)).otherwise(moved)
    return layer.select(moved.alias("rings"))


def read_geojson(spark, path: str) -> DataFrame:
    """rings and properties (JSON text) of each polygon feature of a FeatureCollection; other geometries are left out."""
    shape = "struct<features: array<struct<properties: string, geometry: struct<type: string, coordinates: string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    one = F.from_json(F.col("f.geometry.coordinates"), "array<array<array<double>>>")
    many = F.flatten(F.from_json(F.col("f.geometry.coordinates"), "array<array<array<array<double>>>>"))
    kind = F.col("f.geometry.type")
    opened = lambda rings: F.transform(rings, lambda r: F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))))
    return raw.where(kind.isin("Polygon", "MultiPolygon")).select(opened(F.when(kind == "Polygon", one).otherwise(many)).alias("rings"), F.col("f.properties").alias("properties"))

"""GeoTIFF as pixels: headers and pixel relations read from any store Spark can read, and an encoder.

Files are read whole as binary rows, so one file must stay below Spark's limit for a
binary value (2 GB); a larger scene is a folder of tile files, which the reader puts
on one grid by their georeference.  Strips and tiles, both byte orders, 8 to 64 bit
integers and floats, no compression or deflate, and the horizontal predictor are read;
anything else raises ValueError with the reason.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 and GeoTIFF 1.1 formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC_TYPE, PROJECTED_TYPE = 1024, 1025, 2048, 3072
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KIND = {1: "u", 2: "i", 3: "f"}

#: Rows of pixels a batch.
BATCH = 1 << 17


@dataclass(frozen=True)
class Raster:
    """data (bands, rows, columns); affine (a, b, c, d, e, f) takes (column, row) to the world; epsg and nodata may be missing."""

    data: np.ndarray
    affine: tuple | None = None
    epsg: int | None = None
    nodata: float | None = None

    def valid(self) -> np.ndarray:
        """Some band isn't the no-data value, and all bands are finite."""
        good = np.isfinite(self.data).all(0)
        if self.nodata is not None and not np.isnan(self.nodata):
            good &= (self.data != self.nodata).any(0)
        return good


class _Directory:
    def __init__(self, raw: bytes):
        mark = raw[:2]
        if mark not in (b"II", b"MM") or len(raw) < 8:
            raise ValueError("not a TIFF file")
        self.raw, self.order = raw, "<" if mark == b"II" else ">"
        version, at = struct.unpack_from(self.order + "HI", raw, 2)
        if version != 42:
            raise ValueError(f"TIFF version {version} isn't supported")
        self.tags = {}
        for i in range(struct.unpack_from(self.order + "H", raw, at)[0]):
            tag, kind, n = struct.unpack_from(self.order + "HHI", raw, at + 2 + 12 * i)
            if kind not in FIELD:
                continue
            size = struct.calcsize(FIELD[kind]) * n
            place = at + 10 + 12 * i
            if size > 4:
                place = struct.unpack_from(self.order + "I", raw, place)[0]
            self.tags[tag] = raw[place : place + n].split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack_from(f"{self.order}{n}{FIELD[kind]}", raw, place)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    def affine(self) -> tuple | None:
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return (m[0], m[1], m[3], m[4], m[5], m[7])
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy), (i, j, _, x, y) = self.tags[PIXEL_SCALE][:2], self.tags[TIEPOINT][:5]
            return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        return None

    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = found.get(PROJECTED_TYPE) or found.get(GEOGRAPHIC_TYPE)
        return None if code in (None, 0, 32767) else int(code)

    def nodata(self) -> float | None:
        text = self.tags.get(NODATA)
        return float(text) if isinstance(text, str) and text.strip() else None

    def dtype(self) -> np.dtype:
        bits, form = set(self.tags.get(BITS, (1,))), set(self.tags.get(SAMPLE_FORMAT, (1,)))
        if len(bits) > 1 or len(form) > 1 or bits & {1, 2, 4} or not form <= set(KIND):
            raise ValueError(f"samples of {sorted(bits)} bits and format {sorted(form)} aren't supported")
        return np.dtype(f"{self.order}{KIND[form.pop()]}{bits.pop() // 8}")


def decode(raw: bytes) -> Raster:
    d = _Directory(raw)
    width, height, bands, dtype = d.one(WIDTH), d.one(HEIGHT), d.one(SAMPLES, 1), d.dtype()
    packed, predictor, apart = d.one(COMPRESSION, 1), d.one(PREDICTOR, 1), d.one(PLANAR, 1) == 2
    if packed not in (1, 8, 32946):
        raise ValueError(f"compression {packed} isn't supported")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't supported")
    if TILE_OFFSETS in d.tags:
        bw, bh, offsets, sizes = d.one(TILE_WIDTH), d.one(TILE_HEIGHT), d.tags[TILE_OFFSETS], d.tags[TILE_BYTES]
    else:
        bw, bh, offsets, sizes = width, min(height, d.one(ROWS_PER_STRIP, height)), d.tags[STRIP_OFFSETS], d.tags[STRIP_BYTES]
    across, down, depth = -(-width // bw), -(-height // bh), 1 if apart else bands
    out = np.zeros((bands, height, width), dtype.newbyteorder("="))
    for k, (at, n) in enumerate(zip(offsets, sizes)):
        plane, place = divmod(k, across * down)
        r, c = place // across * bh, place % across * bw
        block = raw[at : at + n]
        if packed != 1:
            block = zlib.decompress(block)
        rows = bh if TILE_OFFSETS in d.tags else min(bh, height - r)
        px = np.frombuffer(block, dtype, rows * bw * depth).reshape(rows, bw, depth).astype(dtype.newbyteorder("="))
        if predictor == 2:
            px = np.cumsum(px, axis=1, dtype=px.dtype)
        px = px[: height - r, : width - c].transpose(2, 0, 1)
        out[plane if apart else slice(None), r : r + px.shape[1], c : c + px.shape[2]] = px[0] if apart else px
    return Raster(out, d.affine(), d.epsg(), d.nodata())


def encode(raster: Raster, strip_rows: int = 256) -> bytes:
    """Little-endian strips with deflate, all bands of a pixel together."""
    data = np.ascontiguousarray(raster.data.transpose(1, 2, 0))
    height, width, bands = data.shape
    data = data.astype(data.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    strips = [zlib.compress(data[r : r + strip_rows].tobytes()) for r in range(0, height, strip_rows)]
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (data.dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)),
        (STRIP_OFFSETS, 4, (0,) * len(strips)), (SAMPLES, 3, (bands,)), (ROWS_PER_STRIP, 4, (strip_rows,)), (STRIP_BYTES, 4, tuple(map(len, strips))),
        (PLANAR, 3, (1,)), (SAMPLE_FORMAT, 3, (kind,) * bands),
    ]
    if raster.affine:
        a, b, c, d, e, f = raster.affine
        if b == 0 and d == 0 and e < 0 < a:
            fields += [(PIXEL_SCALE, 12, (a, -e, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, c, f, 0.0))]
        else:
            fields.append((TRANSFORM, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    if raster.epsg:
        flat = 4000 <= raster.epsg < 5000
        fields.append((GEO_KEYS, 3, (1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if flat else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC_TYPE if flat else PROJECTED_TYPE, 0, 1, raster.epsg)))
    if raster.nodata is not None:
        fields.append((NODATA, 2, tuple(bytes([x]) for x in f"{raster.nodata:g}".encode() + b"\0")))
    fields.sort()
    spare = 8 + 2 + 12 * len(fields) + 4
    places, at = {}, spare
    for tag, form, values in fields:
        size = struct.calcsize(FIELD[form]) * len(values)
        if size > 4:
            places[tag], at = at, at + size + size % 2
    offsets = tuple(at + sum(map(len, strips[:i])) for i in range(len(strips)))
    head, body = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, form, values in fields:
        values = offsets if tag == STRIP_OFFSETS else values
        packed = struct.pack(f"<{len(values)}{FIELD[form]}", *values)
        head += struct.pack("<HHI", tag, form, len(values))
        if tag in places:
            head += struct.pack("<I", places[tag])
            body += packed + b"\0" * (len(packed) % 2)
        else:
            head += packed.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + body + b"".join(strips)


HEADER = "path string, length long, sha256 string, width int, height int, bands int, dtype string, epsg int, affine array<double>, nodata double, valid_fraction double, has_nonfinite boolean, spread double, error string"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: what its header says, content hash, share of valid pixels, spread of valid values; error says why a file can't be read."""

    def run(parts):
        for pdf in parts:
            out = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                row = {"path": name, "length": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
                try:
                    r = decode(raw)
                    good, wide = r.valid(), np.issubdtype(r.data.dtype, np.floating)
                    row |= {"width": r.data.shape[2], "height": r.data.shape[1], "bands": r.data.shape[0], "dtype": r.data.dtype.name, "epsg": r.epsg, "affine": list(r.affine) if r.affine else None, "nodata": r.nodata}
                    row |= {"valid_fraction": float(good.mean()), "has_nonfinite": bool(wide and not np.isfinite(r.data).all()), "spread": float(r.data[:, good].std(dtype=float)) if good.any() else None}
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
            names = [x.split()[0] for x in HEADER.split(", ")]
            yield pd.DataFrame([[row.get(n) for n in names] for row in out], columns=names).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, HEADER)


def pixels(spark: SparkSession, path: str, max_bands: int | None = None, origin: tuple[float, float] | None = None) -> DataFrame:
    """(row, col, b array<double>, valid) of one file, or of a folder of tiles of one grid.

    origin is the world place of the grid's upper-left corner; without it, each file
    starts at row 0, column 0."""

    def run(parts):
        for pdf in parts:
            for raw in pdf["content"]:
                r = decode(raw)
                data, good = r.data[:max_bands], r.valid()
                row0 = col0 = 0
                if origin is not None and r.affine:
                    col0, row0 = round((r.affine[2] - origin[0]) / r.affine[0]), round((r.affine[5] - origin[1]) / r.affine[4])
                step = max(1, BATCH // data.shape[2])
                for at in range(0, data.shape[1], step):
                    part = data[:, at : at + step]
                    rows, cols = np.indices(part.shape[1:], dtype=np.int32)
                    flat = part.reshape(len(part), -1).T.astype(float)
                    yield pd.DataFrame({"row": rows.ravel() + np.int32(at + row0), "col": cols.ravel() + np.int32(col0), "b": list(flat), "valid": good[at : at + step].ravel()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row int, col int, b array<double>, valid boolean")


def scale_of(dtype: str, uint8_scale: float = 255.0, uint16_scale: float = 10000.0) -> float:
    """What a sample type is divided by to reach 0..1."""
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return 1.0
    return uint8_scale if kind == np.uint8 else uint16_scale if kind.itemsize == 2 else float(np.iinfo(kind).max)


def pair(before: DataFrame, after: DataFrame, scales: tuple[float, float] = (255.0, 255.0), bands: int = 3) -> DataFrame:
    """The pair relation (row, col, b1.., a1.., valid) of two pixel relations on one grid; a lacking band repeats the last one."""
    from ..functions.pixel import normalise

    def side(df, name, scale):
        nth = lambda i: F.element_at("b", F.least(F.lit(i), F.size("b")))
        return df.select("row", "col", *[normalise(nth(i), scale).alias(f"{name}{i}") for i in range(1, bands + 1)], F.col("valid").alias(f"valid_{name}"))

    both = side(before, "b", scales[0]).join(side(after, "a", scales[1]), ["row", "col"])
    return both.withColumn("valid", F.col("valid_b") & F.col("valid_a")).drop("valid_b", "valid_a")


def tiles(values: DataFrame, column: str | list[str], dtype: str, affine: tuple, epsg: int | None = None, nodata: float | None = None, tile: int = 1024) -> DataFrame:
    """(tile_row, tile_col, content) of a grid of values, a band a column: each tile encoded as a file of its own where its pixels are, for scenes of any size."""

    columns = [column] if isinstance(column, str) else column

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        grid = np.full((len(columns), r.max() + 1 - key[0] * tile, c.max() + 1 - key[1] * tile), 0 if nodata is None else nodata, dtype)
        for i in range(len(columns)):
            grid[i, r - key[0] * tile, c - key[1] * tile] = pdf[f"v{i}"]
        a, b, x, d, e, y = affine
        at = (a, b, x + a * key[1] * tile + b * key[0] * tile, d, e, y + d * key[1] * tile + e * key[0] * tile)
        return pd.DataFrame({"tile_row": [key[0]], "tile_col": [key[1]], "content": [encode(Raster(grid, at, epsg, nodata))]})

    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    return values.select(at("row").alias("tile_row"), at("col").alias("tile_col"), "row", "col", *[F.col(n).alias(f"v{i}") for i, n in enumerate(columns)]).groupBy("tile_row", "tile_col").applyInPandas(run, "tile_row int, tile_col int, content binary")

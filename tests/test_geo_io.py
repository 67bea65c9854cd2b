import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.functions import projection
from terradelta.sources import geotiff


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "int32", "float32", "float64"])
def test_encoded_rasters_come_back(dtype):
    data = (np.random.default_rng(1).random((3, 70, 41)) * 200).astype(dtype)
    for affine, epsg, nodata in (((0.5, 0, 500000, 0, -0.5, 4500000), 32633, 0), (None, None, None), ((1e-5, 1e-6, 10, 1e-6, -1e-5, 50), 4326, -9999)):
        back = geotiff.decode(geotiff.encode(geotiff.Raster(data, affine, epsg, nodata), 16))
        assert back.data.dtype == data.dtype and (back.data == data).all()
        assert (back.affine, back.epsg, back.nodata) == (affine, epsg, nodata)


def test_files_become_pixels(spark, tmp_path):
    data = np.arange(2 * 4 * 6, dtype="uint8").reshape(2, 4, 6)
    for name, part, x in (("west", data[:, :, :3], 100.0), ("east", data[:, :, 3:], 103.0)):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(geotiff.Raster(part, (1, 0, x, 0, -1, 50), 32633, 0)))
    got = geotiff.pixels(spark, str(tmp_path), origin=(100.0, 50.0)).collect()
    assert {(r.row, r.col): tuple(r.b) for r in got} == {(i, j): tuple(data[:, i, j]) for i in range(4) for j in range(6)}
    (tmp_path / "bad.tif").write_bytes(b"nothing of the kind")
    heads = {r.path.rsplit("/")[-1]: r for r in geotiff.headers(spark, str(tmp_path)).collect()}
    assert heads["bad.tif"].error and heads["west.tif"].epsg == 32633 and heads["west.tif"].width == 3


def test_tiles_hold_the_grid(spark):
    grid = spark.range(50).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    for t in geotiff.tiles(grid, "v", "float32", (1, 0, 0, 0, -1, 9), 32633, -9999, 4).collect():
        r = geotiff.decode(bytes(t.content))
        for i in range(r.data.shape[1]):
            for j in range(r.data.shape[2]):
                assert r.data[0, i, j] == (t.tile_row * 4 + i) * 10 + t.tile_col * 4 + j
        assert r.affine[2] == t.tile_col * 4 and r.affine[5] == 9 - t.tile_row * 4


def test_utm(spark):
    # the equator at a zone's middle, and a place 3 degrees off against the series of the meridian
    at = spark.createDataFrame([(15.0, 0.0), (15.0, 45.0), (17.9, 60.0), (12.1, 5.0)], "lon double, lat double")
    x, y = projection.from_geographic("lon", "lat", 32633)
    lon, lat = projection.to_geographic(x, y, 32633)
    rows = at.select("lon", "lat", x.alias("x"), y.alias("y"), lon.alias("lon2"), lat.alias("lat2")).collect()
    assert (rows[0].x, rows[0].y) == pytest.approx((500000, 0), abs=1e-6)
    # the meridian's length to 45 degrees is 4984944.378 m
    assert rows[1].y == pytest.approx(0.9996 * 4984944.378, abs=1e-3)
    for r in rows:
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-9)
    with pytest.raises(ValueError):
        projection.is_metric(27700)

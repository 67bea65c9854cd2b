import json
import os

import numpy as np
import pytest

from terradelta.plans import evaluate
from terradelta.plans.run import AlignmentError, ValidationError, run_pipeline
from terradelta.plans.validate import compare
from terradelta.sinks import record
from terradelta.sources import geotiff


def info(**more):
    return {"path": "x", "length": 1, "sha256": "0", "width": 100, "height": 80, "bands": 3, "dtype": "uint8", "epsg": 32633, "affine": [0.5, 0, 5e5, 0, -0.5, 45e5], "nodata": None, "valid_fraction": 1.0, "has_nonfinite": False, "spread": 9.0, "error": None} | more


@pytest.mark.parametrize(
    "change, wrong",
    [({}, None), ({"epsg": 32634}, "Pair CRS"), ({"epsg": None}, "After CRS"), ({"epsg": 27700}, "After CRS"), ({"bands": 1}, "Pair bands"), ({"spread": 0.0}, "After content"), ({"spread": None}, "After content"),
     ({"valid_fraction": 0.001}, "After valid data"), ({"affine": [0.5, 0, 5e5 + 0.25, 0, -0.5, 45e5]}, "Pair grid"), ({"affine": [0.5, 0, 6e5, 0, -0.5, 45e5]}, "Pair overlap"), ({"affine": None}, "After transform"), ({"error": "bad"}, "After file")],
)
def test_checks(change, wrong):
    report = compare(info(), info(**change))
    assert report.ok == (wrong is None)
    assert wrong is None or any(c.name == wrong and c.status == "fail" for c in report.checks)
    assert not compare(None, info()).ok


def test_run_finds_the_known_regions(spark, tmp_path):
    paths = evaluate.write_synthetic_pair(spark, str(tmp_path / "in"), 256)
    got = run_pipeline(spark, paths["before"], paths["after"], str(tmp_path / "out"), run_name="one")
    rows = got.regions.collect()
    assert len(rows) == 3 and [r.change_id for r in rows] == ["CHG-0001", "CHG-0002", "CHG-0003"]
    assert sorted(r.area_m2 for r in rows) == pytest.approx(sorted([15 * 20, 10 * 10, 15 * 15]), rel=0.06)
    m = evaluate.metrics(spark, got, paths["reference_mask"]).first()
    assert m.iou > 0.9 and m.recall > 0.95
    folder = got.folder
    assert {"change_score.tif", "change_mask.tif", "change_polygons.geojson", "change_polygons.gpkg", "viewer.html", "provenance.json", "validation_report.json", "config_snapshot.json"} <= set(os.listdir(folder))
    mask = geotiff.decode(open(f"{folder}/change_mask.tif", "rb").read())
    assert mask.nodata == 255 and int((mask.data == 1).sum()) == got.labels.count() and mask.epsg == 32633
    said = json.load(open(f"{folder}/provenance.json"))
    assert said["status"] == "ok" and said["counts"]["polygons_after_area_filter"] == 3
    assert said["manifest_sha256"]["viewer.html"]["sha256"] == record.file_sha256(f"{folder}/viewer.html")
    assert len(json.load(open(f"{folder}/change_polygons.geojson"))["features"]) == 3


def test_gate_blocks_and_correction_passes(spark, tmp_path):
    r, c = np.indices((160, 160))
    rng = np.random.default_rng(5)
    ground = np.kron(rng.integers(40, 200, (20, 20)), np.ones((8, 8))).astype(np.uint8)
    write = lambda name, x: (tmp_path / name).write_bytes(geotiff.encode(geotiff.Raster(np.stack([x] * 3), (0.5, 0, 5e5, 0, -0.5, 45e5), 32633))) and str(tmp_path / name)
    before, after = write("b.tif", ground), write("a.tif", np.roll(ground, 4, 1))
    with pytest.raises(AlignmentError):
        run_pipeline(spark, before, after, str(tmp_path), run_name="blocked")
    assert json.load(open(tmp_path / "blocked" / "provenance.json"))["status"] == "failed_alignment"
    got = run_pipeline(spark, before, after, str(tmp_path), run_name="fixed", auto_correct=True)
    assert got.alignment["magnitude_px"] < 0.5
    aligned = geotiff.decode(open(f"{got.folder}/after_aligned.tif", "rb").read())
    inside = aligned.data[:, 8:-8, 8:-8]
    assert len(aligned.data) == 3 and np.abs(inside - ground[8:-8, 8:-8]).mean() < 2 and "alignment" in open(f"{got.folder}/run.log").read()
    assert "AlignmentError" in open(tmp_path / "blocked" / "run.log").read()
    with pytest.raises(ValidationError):
        run_pipeline(spark, before, str(tmp_path / "none.tif"), str(tmp_path), run_name="missing")
    assert json.load(open(tmp_path / "missing" / "provenance.json"))["status"] == "failed_validation"


def test_demos(spark, tmp_path):
    rows = {r.scene: r for r in evaluate.failure_demos(spark, str(tmp_path), 192, names=("illumination", "missing data")).collect()}
    assert rows["illumination"].for_review == rows["illumination"].regions > 0
    assert rows["missing data"].status == "ok" and rows["missing data"].on_missing_data == 0 and rows["missing data"].regions == 3
    assert {"failure_demos.md", "failure_demos.json", "failure_demos.csv"} <= set(os.listdir(tmp_path))
    assert json.load(open(tmp_path / "missing_data" / "meta.json"))["options"] == {"no_data": True}


def test_synthetic_options(spark):
    from terradelta.sources import scenes

    plain = scenes.synthetic_scene(spark, 128).toPandas().set_index(["row", "col"])
    full = scenes.synthetic_scene(spark, 128, season=True, no_data=True, converted=True, road=True).toPandas().set_index(["row", "col"])
    assert plain["valid"].all() and int((~full["valid"]).sum()) == 64 and full["ref"].sum() > plain["ref"].sum()
    assert abs((full["b2"] - full["a2"]).loc[(90, 80)] - 0.2) < 0.03 and not full["ref"].loc[(90, 80)]

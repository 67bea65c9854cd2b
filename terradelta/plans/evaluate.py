"""Accuracy of whole runs against a reference mask: threshold methods, and robustness against shifts."""

from __future__ import annotations

import csv
import os
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..sinks import record
from ..sources import geotiff, scenes
from . import change
from .run import AlignmentError, Result, ValidationError, run_pipeline


def write_synthetic_pair(spark: SparkSession, folder: str, size: int = 512, shift: int = 0, gsd: float = 0.5, epsg: int = 32633, origin: tuple[float, float] = (500000.0, 4500000.0), **options) -> dict[str, str]:
    """before.tif, after.tif, reference_mask.tif and meta.json of scenes.synthetic_scene, whose size bounds what the driver gets.

    options are those of the scene; a place without data is 0 in both files, whose no-data value is 0 then."""
    os.makedirs(folder, exist_ok=True)
    pdf = scenes.synthetic_scene(spark, size, shift, **options).toPandas()
    paths = {}
    for name, columns, scale in (("before", ["b1", "b2", "b3"], 255), ("after", ["a1", "a2", "a3"], 255), ("reference_mask", ["ref"], 1)):
        values = np.clip(np.rint(pdf[columns].to_numpy(float) * scale), 0 if scale == 1 else 1, 255)
        values[~pdf["valid"].to_numpy(bool)] = 0
        data = np.zeros((len(columns), size, size), np.uint8)
        data[:, pdf["row"], pdf["col"]] = values.T
        paths[name] = os.path.join(folder, f"{name}.tif")
        with open(paths[name], "wb") as f:
            f.write(geotiff.encode(geotiff.Raster(data, (gsd, 0.0, origin[0], 0.0, -gsd, origin[1]), epsg, 0 if options.get("no_data") and scale > 1 else None)))
    changed = int(pdf["ref"].sum())
    paths["meta"] = os.path.join(folder, "meta.json")
    record.write_json(paths["meta"], {"size": size, "gsd_m": gsd, "epsg": epsg, "origin": origin, "shift_px": shift, "options": options, "changed_pixels": changed, "changed_area_m2": changed * gsd * gsd})
    return paths


def write_table(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """name.json and name.csv of a table of a few rows, which it returns."""
    os.makedirs(folder, exist_ok=True)
    found = [r.asDict() for r in rows.collect()]
    record.write_json(os.path.join(folder, f"{name}.json"), found)
    with open(os.path.join(folder, f"{name}.csv"), "w", newline="") as f:
        w = csv.DictWriter(f, rows.columns)
        w.writeheader()
        w.writerows(found)
    return rows


def metrics(spark: SparkSession, result: Result, reference: str) -> DataFrame:
    """Confusion of a run's regions with band 1 > 0 of the reference, over valid pixels, and the false-alarm area."""
    ref = geotiff.pixels(spark, reference, 1).select("row", "col", (F.element_at("b", 1) > 0).alias("ref"))
    rows = result.marked.where("valid").select("row", "col").join(ref, ["row", "col"]).join(result.labels.select("row", "col", F.lit(True).alias("hit")), ["row", "col"], "left")
    return change.confusion(rows.select(F.coalesce("hit", F.lit(False)).alias("pred"), "ref")).withColumn("false_alarm_m2", F.round(F.col("fp") * result.counts["pixel_area_m2"], 4))


def evaluate(spark: SparkSession, before: str, after: str, reference: str, out: str, config: Config = Config(), methods: tuple = ("otsu", "percentile", "fixed")) -> DataFrame:
    """A row of metrics a threshold method, in out as evaluation.json and .csv too."""
    rows = []
    for method in methods:
        result = run_pipeline(spark, before, after, out, replace(config, detection=replace(config.detection, threshold_method=method)), run_name=f"evaluate_{method}")
        rows.append({"method": method, "threshold": result.counts["threshold"], "regions": result.counts["polygons_after_area_filter"], **metrics(spark, result, reference).first().asDict()})
    return write_table(spark.createDataFrame(rows, "method string, threshold double, regions long, tp long, fp long, fn long, tn long, precision double, recall double, iou double, f1 double, false_alarm_m2 double"), out, "evaluation")


def shift_robustness(spark: SparkSession, out: str, shifts: tuple = (0, 1, 2, 5), size: int = 512, config: Config = Config()) -> DataFrame:
    """A row of metrics a shift and mode: the gate on, overridden, or with correction.  A blocked run has a status and no metrics.  Also in out as shift_robustness.json and .csv."""
    rows = []
    for shift in shifts:
        paths = write_synthetic_pair(spark, os.path.join(out, f"pair_{shift}"), size, shift)
        for mode, options in (("gate", {}), ("override", {"allow_misaligned": True}), ("corrected", {"auto_correct": True})):
            row = {"shift_px": shift, "mode": mode}
            try:
                result = run_pipeline(spark, paths["before"], paths["after"], out, config, run_name=f"shift_{shift}_{mode}", **options)
                rows.append(row | {"status": "ok", **metrics(spark, result, paths["reference_mask"]).first().asDict()})
            except AlignmentError:
                rows.append(row | {"status": "blocked_by_gate"})
    return write_table(spark.createDataFrame(rows, "shift_px int, mode string, status string, tp long, fp long, fn long, tn long, precision double, recall double, iou double, f1 double, false_alarm_m2 double"), out, "shift_robustness")


#: Scenes that a run must not report as plain change: what is made, whether the gate may block, and what is expected of it.
DEMOS = {
    "misaligned": ({"shift": 5, "road": True}, True, "blocked by the gate, or every region for review"),
    "coarse pixels": ({"gsd": 20.0}, True, "no building tag: the scene fits no policy for buildings"),
    "illumination": ({"gain": 1.6, "offset": 0.16}, False, "with the gate not blocking, every region for review"),
    "missing data": ({"no_data": True}, True, "no region where a date holds no data"),
}


def failure_demos(spark: SparkSession, out: str, size: int = 256, config: Config = Config(), names: tuple = tuple(DEMOS)) -> DataFrame:
    """A row a scene of DEMOS with what the run said of it; failure_demos.md, .json and .csv in out."""
    rows = []
    for name in names:
        options, block, expected = DEMOS[name]
        where = os.path.join(out, name.replace(" ", "_"))
        paths = write_synthetic_pair(spark, where, size, **options)
        row = {"scene": name, "expected": expected, "policy": None, "changed_fraction": None, "regions": 0, "for_review": 0, "building_like": 0, "on_missing_data": 0}
        try:
            got = run_pipeline(spark, paths["before"], paths["after"], where, replace(config, alignment=replace(config.alignment, block_on_fail=block)), run_name="run")
            n = got.regions.agg(F.count(F.lit(1)), F.count_if(F.col("severity_tier") == "Review"), F.count_if(F.col("tags").contains("building_like"))).first()
            missing = got.labels.join(got.marked.where("not valid"), ["row", "col"], "left_semi").count()
            row |= {"status": "ok", "policy": got.policy, "changed_fraction": got.counts["changed_fraction"], "regions": n[0], "for_review": n[1], "building_like": n[2], "on_missing_data": missing}
        except (AlignmentError, ValidationError) as e:
            row |= {"status": f"{type(e).__name__}: {e}"}
        rows.append(row)
    table = spark.createDataFrame(rows, "scene string, status string, policy string, changed_fraction double, regions long, for_review long, building_like long, on_missing_data long, expected string")
    with open(os.path.join(out, "failure_demos.md"), "w") as f:
        f.write("| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns) + "\n")
        f.writelines("| " + " | ".join("" if r[c] is None else str(r[c]) for c in table.columns) + " |\n" for r in rows)
    return write_table(table, out, "failure_demos")

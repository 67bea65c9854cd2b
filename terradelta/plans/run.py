"""A whole run: two rasters in, a folder of rasters, vectors, viewer and provenance out.

Pixels and regions stay in DataFrames; the driver holds header rows, at most a few
alignment windows, previews of bounded size and one partition of regions at a time.
The folder must be one the driver can write; pixel files go there tile by tile.
"""

from __future__ import annotations

import json
import logging
import os
import time
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import pixel as P
from ..operators import detect, regions, registration, rules, vectors
from ..operators.regions import _checkpointed as kept
from ..sinks import pictures, record
from ..sinks import vectors as files
from ..sources import geotiff
from . import change
from .validate import validate_pair

log = logging.getLogger(__name__)
TILE = 2048


class ValidationError(ValueError):
    """The pair can't be compared."""


class AlignmentError(ValueError):
    """The gate blocked a misaligned pair."""


@dataclass(frozen=True)
class Result:
    folder: str
    regions: DataFrame
    labels: DataFrame
    marked: DataFrame
    counts: dict
    alignment: dict
    policy: str
    warnings: list


def write_raster(values: DataFrame, column: str | list[str], dtype: str, info: dict, nodata: float, path: str) -> str:
    """One file for a scene of one tile, else a folder of tile files; returns its name."""
    tiled = geotiff.tiles(values, column, dtype, tuple(info["affine"]), info["epsg"], nodata, TILE)
    single = max(info["width"], info["height"]) <= TILE
    if not single:
        path = path.removesuffix(".tif")
        os.makedirs(path, exist_ok=True)
    for t in tiled.toLocalIterator():
        with open(path if single else f"{path}/r{t.tile_row:05d}_c{t.tile_col:05d}.tif", "wb") as f:
            f.write(t.content)
    return os.path.basename(path)


EVIDENCE = ["change_magnitude", "confidence", "d_veg", "d_built", "d_lum", "chroma", "nodata", "edge", "compactness", "width", "length", "extent", "elongation", "iou"]


def region_attributes(labels: DataFrame, pair: DataFrame, marked: DataFrame, info: dict, config: Config, deltas, other_mask: DataFrame | None) -> DataFrame:
    """Regions with rings in pixels, metric attributes and the evidence of the tag rules."""
    a, b, _, d, e, _ = info["affine"]
    side = abs(a * e - b * d) ** 0.5
    table = change.region_table(pair, labels, deltas, marked.select("threshold").limit(1), side, marked.drop("threshold", "mask"))
    table = change.with_evidence(table, labels, pair, config, side)
    shapes = regions.polygons(labels).select("label", F.col("rings").alias("pixel_rings"))
    shapes = vectors.metric_attributes(shapes.withColumn("rings", vectors.world_rings("pixel_rings", tuple(info["affine"]))), info["epsg"])
    table = table.join(shapes, "label").withColumn("area", F.col("area_m2"))
    if other_mask is not None:
        table = table.drop("iou").join(change.overlap(labels, other_mask), "label")
    return table


def run_pipeline(
    spark: SparkSession,
    before: str,
    after: str,
    out_root: str,
    config: Config = Config(),
    run_name: str | None = None,
    mode: str | None = None,
    allow_misaligned: bool = False,
    auto_correct: bool | None = None,
    band_map: dict[str, int] | None = None,
    context_layers: dict[str, str] | None = None,
    other_mask: DataFrame | None = None,
    notes: str = "",
) -> Result:
    """mode and auto_correct override the settings only where given.  context_layers: name -> path of a GeoJSON or GeoPackage file in any supported system.

    run.log in the run's folder holds what was done when; it is closed before the manifest is made."""
    began = time.time()
    if mode:
        config = replace(config, severity=replace(config.severity, mode=mode))
    band_map = band_map or config.bands.band_map or None
    context_layers = context_layers or {os.path.splitext(os.path.basename(p))[0]: p for p in config.severity.context_layers}
    folder = os.path.join(out_root, run_name or datetime.now().strftime("run_%Y%m%d_%H%M%S"))
    os.makedirs(folder, exist_ok=True)
    at = lambda name: os.path.join(folder, name)
    with record.logged(at("run.log"), began) as say:
        return _run(spark, before, after, folder, at, say, config, allow_misaligned, auto_correct, band_map, context_layers, other_mask, notes, began)


def _run(spark, before, after, folder, at, say, config, allow_misaligned, auto_correct, band_map, context_layers, other_mask, notes, began) -> Result:
    say(f"compares {before} with {after}, mode {config.severity.mode}")
    base = {"tool": "terradelta", "input_notes": notes, "severity_mode": config.severity.mode, "config_hash_sha256": record.config_snapshot(config, at("config_snapshot.json"))}

    report = validate_pair(spark, before, after, config.validation)
    record.write_json(at("validation_report.json"), report.to_dict())
    if not report.ok:
        record.write_provenance(at("provenance.json"), {**base, "status": "failed_validation", "errors": report.of("fail"), "warnings": report.of("warn")})
        raise ValidationError("; ".join(report.of("fail")))
    info, warnings = report.before, report.of("warn")
    say(f"{info['width']} by {info['height']} pixels of {info['bands']} band(s) can be compared")
    base |= {"inputs": [{k: x[k] for k in ("path", "length", "sha256")} for x in (report.before, report.after)], "source_pair_id": record.pair_id(report.before["sha256"], report.after["sha256"])}

    depth = max(3, info["bands"], *(band_map or {"red": 1}).values())
    d = config.detection
    scales = tuple(geotiff.scale_of(x["dtype"], d.uint8_scale, d.uint16_scale) for x in (report.before, report.after))
    pair = kept(geotiff.pair(geotiff.pixels(spark, before), geotiff.pixels(spark, after), scales, depth))
    height, width = info["height"], info["width"]

    gate = lambda p: registration.estimate_alignment(p, width, height, config.alignment, info["gsd_x_m"])
    alignment = first = gate(pair)
    outputs = {}
    if (config.alignment.auto_correct if auto_correct is None else auto_correct) and first["shift_row_px"] is not None:
        pair = kept(registration.corrected(pair, first["shift_row_px"], first["shift_col_px"], {"spline": "cubic"}.get(config.alignment.interpolation, config.alignment.interpolation)))
        alignment = gate(pair) | {"corrected_by_px": [first["shift_row_px"], first["shift_col_px"]]}
        # all bands, in the units of the file that was read
        moved = [f"a{i}" for i in range(1, report.after["bands"] + 1)]
        unit = pair.select("row", "col", *[F.when(F.col("valid"), F.col(c) * scales[1]).otherwise(-9999.0).alias(c) for c in moved])
        outputs["after_aligned"] = write_raster(unit, moved, "float32", info, -9999, at("after_aligned.tif"))
    if alignment["status"] == "fail" and config.alignment.block_on_fail and not allow_misaligned:
        record.write_provenance(at("provenance.json"), {**base, "status": "failed_alignment", "alignment": alignment, "warnings": warnings, "errors": alignment["reasons"]})
        raise AlignmentError("; ".join(alignment["reasons"]))

    say(f"alignment: {alignment['status']}, {alignment['magnitude_px']} px")
    indices = bool(band_map) and ({"nir", "red"} <= set(band_map) or {"swir1", "nir"} <= set(band_map))
    policy = spark.range(1).select(rules.route(F.lit(info["gsd_x_m"]), F.lit(info["bands"]), F.lit(indices), config.routing)).first()[0]
    bands = min(info["bands"], d.max_bands, 3)
    scored, deltas = None, change.rgb_deltas
    if policy == "multispectral_coarse":
        scored, have = detect.spectral_scores(pair, band_map)
        null = F.lit(None).cast("double")
        deltas = lambda df: df.withColumns({n: F.col(n) if n[2:] in have else null for n in ("d_ndvi", "d_ndbi")})
        if "ndvi" not in have:
            vegetation = deltas
            deltas = lambda df: vegetation(df).withColumn("d_ndvi", F.col("d_exg") if "exg" in have else null)
    if policy == "fallback":
        warnings.append("the scene fits no policy: regions are unverified change")
    marked = kept(change.marked_scores(pair, config, scored, bands))

    pixel_area = info["gsd_x_m"] * info["gsd_y_m"]
    every, labels = change.clean_labels(marked, config, pixel_area)
    labels = kept(labels)
    table = kept(region_attributes(labels, pair, marked, info, config, deltas, other_mask))

    n = marked.agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("all"), F.max("threshold").alias("threshold")).first()
    changed = labels.count() / max(1, n["valid"])
    implausible = changed > config.severity.implausible()
    tagged = rules.tag(table, config.tagging, policy, alignment["status"], alignment["magnitude_px"] or 0.0)
    found = {}
    for name, path in (context_layers or {}).items():
        try:
            found[name] = files.read_layer(spark, path, info["epsg"])  # a missing or refused one shows here
        except Exception as e:  # noqa: BLE001  a layer that can't be read only warns
            warnings.append(f"context layer {name}: {str(e).splitlines()[0]}")
    tagged = vectors.context_hits(tagged, found, "label", max(64 * abs(info["affine"][0]), 1e-9))
    judged = rules.review(rules.severity(tagged, config.severity, "hits" if found else None), alignment["status"], allow_misaligned, F.lit(implausible))
    before_filter = judged.count()
    judged = regions.change_ids(judged).where(F.col("area_m2") >= config.postprocessing.min_mapping_unit_m2)
    judged = vectors.simplify(judged, config.polygons.simplify_tolerance_px * abs(info["affine"][0]))
    evidence = F.to_json(F.struct(*[P.exact_rounded(c, 4).alias(c) for c in EVIDENCE])).alias("tag_evidence")
    final = kept(
        judged.select(
            "change_id", "area_m2", "centroid_lon", "centroid_lat", "centroid_x", "centroid_y", "projected_epsg", "change_magnitude", "confidence", "pixel_count",
            F.lit(base["source_pair_id"]).alias("source_pair_id"), F.lit("spectral" if scored is not None else "rms").alias("detector_used"),
            "type_tag", "tags", evidence, "base_severity", "severity_tier", "review_reasons", "quality_flag", "context_hits", "label", "pixel_rings", "rings",
        ).orderBy("change_id")
    )

    sink = marked.select("row", "col", F.when(F.col("valid"), F.col("score")).otherwise(-9999.0).alias("score"), F.when(~F.col("valid"), 255).otherwise(0).alias("base"))
    mask = sink.join(labels.select("row", "col", F.lit(1).alias("hit")), ["row", "col"], "left").withColumn("mask", F.coalesce("hit", "base"))
    outputs["score"] = write_raster(sink, "score", "float32", info, -9999, at("change_score.tif"))
    outputs["mask"] = write_raster(mask, "mask", "uint8", info, 255, at("change_mask.tif"))
    flat = final.drop("label", "pixel_rings")
    files.write_geojson(flat, at("change_polygons.geojson"), epsg=info["epsg"])
    files.write_geopackage(flat, at("change_polygons.gpkg"), info["epsg"])
    files.write_csv(flat, "file://" + os.path.abspath(at("change_polygons_csv")))
    shown, later = pictures.pair_previews(pair, height, width)
    pictures.viewer(final.drop("rings").withColumnRenamed("pixel_rings", "rings"), {"before": shown, "after": later, "heat": pictures.heat_preview(marked, height, width)}, height, width, at("viewer.html"))
    outputs |= {"geojson": "change_polygons.geojson", "geopackage": "change_polygons.gpkg", "csv": "change_polygons_csv", "viewer": "viewer.html"}

    count = lambda df: df.select("label").distinct().count()
    total = final.agg(F.count(F.lit(1)), F.coalesce(F.sum("area_m2"), F.lit(0.0))).first()
    counts = {
        "valid_pixel_fraction": n["valid"] / max(1, n["all"]), "changed_fraction": round(changed, 4), "implausible_change_fraction": implausible, "threshold": n["threshold"], "threshold_method": d.threshold_method,
        "pixel_area_m2": pixel_area, "components_raw": count(regions.components(marked.where("mask"), config.polygons.connectivity)), "components_after_morphology": count(every), "components_after_mmu": count(labels),
        "polygons_before_area_filter": before_filter, "polygons_after_area_filter": total[0], "total_changed_area_m2": total[1],
    }
    if implausible:
        warnings.append(f"{changed:.1%} of the valid pixels changed, which is implausible")
    if allow_misaligned:
        warnings.append("the alignment gate was overridden")
    if not total[0]:
        warnings.append("no region was found")
    for w in warnings:
        say(f"warning: {w}")
    say(f"policy {policy}, counts {json.dumps(counts, default=str)}")
    log.info("%s: %s", folder, json.dumps(counts, default=str))
    record.write_provenance(
        at("provenance.json"),
        {**base, "status": "ok", "warnings": warnings, "alignment": alignment, "initial_alignment": first, "routing": policy, "counts": counts, "outputs": outputs, "manifest_sha256": record.manifest(folder), "elapsed_seconds": round(time.time() - began, 2)},
    )
    return Result(folder, final, labels, marked, counts, alignment, policy, warnings)

"""Whole runs and the joins they are made of."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import pixel as P
from ..operators import detect, regions, rules, stencil


def overlap(labels: DataFrame, other: DataFrame) -> DataFrame:
    """label, iou of each region with the whole of another mask."""
    total = other.agg(F.count(F.lit(1)).alias("n_other"))
    hit = labels.join(other.select("row", "col", F.lit(1).alias("hit")), ["row", "col"], "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit"))
    return hit.crossJoin(F.broadcast(total)).select("label", F.coalesce(F.try_divide("hit", F.col("n") + F.col("n_other") - F.col("hit")), F.lit(0.0)).alias("iou"))


def confusion(rows: DataFrame) -> DataFrame:
    """One row from boolean pred and ref: counts, and ratios that are null where undefined."""
    p, r = F.col("pred"), F.col("ref")
    n = rows.agg(F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(~p & r).alias("fn"), F.count_if(~p & ~r).alias("tn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": ratio("tp", tp + fp), "recall": ratio("tp", tp + fn), "iou": ratio("tp", tp + fp + fn), "f1": F.try_divide((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double"))})


def bbox_overlap(one: list[Column], two: list[Column]) -> Column:
    """Shared area of two (west, south, east, north) boxes over the smaller area."""
    width = F.greatest(F.lit(0.0), F.least(one[2], two[2]) - F.greatest(one[0], two[0]))
    height = F.greatest(F.lit(0.0), F.least(one[3], two[3]) - F.greatest(one[1], two[1]))
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return F.try_divide(width * height, F.least(area(one), area(two)))


def region_table(pair: DataFrame, labels: DataFrame, deltas: Callable[[DataFrame], DataFrame], threshold: DataFrame, pixel: float = 0.5, scored: DataFrame | None = None) -> DataFrame:
    """Shape and mean evidence of every region, with what the tag rules need.

    change_magnitude is the mean score, confidence the mean margin above the threshold (one row)."""
    lum = P.luminance(*detect.AFTER) - P.luminance(*detect.BEFORE)
    rgb = P.rms(detect.BEFORE, detect.AFTER)
    facts = deltas(scored if scored is not None else detect.rms_scores(pair)).withColumn("d_lum", lum).withColumn("chroma", rgb).drop("threshold")
    limit = threshold.select(F.col("threshold").alias("_t"))
    means = labels.select("label", "row", "col").join(facts, ["row", "col"]).crossJoin(F.broadcast(limit)).groupBy("label").agg(
        F.round(F.avg("score"), 4).alias("change_magnitude"),
        F.round(F.avg(P.margin("score", "_t")), 4).alias("confidence"),
        # twelve digits drop only the noise of summing in another order; the tags decide on these values, not on rounded evidence
        *[F.round(F.avg(c), 12).alias(n) for c, n in (("d_ndvi", "d_veg"), ("d_ndbi", "d_built"), ("d_lum", "d_lum"), ("chroma", "chroma"))],
        F.avg((~F.col("valid")).cast("double")).alias("nodata"),
    )
    none = F.lit(None).cast("double")
    return regions.shapes(labels, pixel).join(means, "label").withColumns({"elongation": none, "edge": none, "width": none, "iou": none})


def rgb_deltas(df: DataFrame) -> DataFrame:
    """Excess green in place of the vegetation index; no built-up index."""
    side = lambda s: {"red": f"{s}1", "green": f"{s}2", "blue": f"{s}3"}
    exg = P.spectral_index("exg", side("a"))[0] - P.spectral_index("exg", side("b"))[0]
    return df.withColumn("d_ndvi", exg).withColumn("d_ndbi", F.lit(None).cast("double"))


def marked_scores(pair: DataFrame, config: Config = Config(), scored: DataFrame | None = None, bands: int = 3) -> DataFrame:
    """Scores smoothed, with threshold and mask."""
    d = config.detection
    if scored is None:
        scored = detect.rms_scores(pair, bands)
        if d.radiometric_normalization:
            matched = {"mean_std": detect.match_mean_std, "robust": detect.match_robust}[d.radiometric_norm_method](pair)
            scored = pair.drop("score").join(detect.rms_scores(matched, bands).select("row", "col", "score"), ["row", "col"])
    return detect.change_mask(stencil.smooth(scored, d.smoothing_sigma_px), d.threshold_method, d.percentile / 100 if d.threshold_method == "percentile" else d.fixed_threshold)


def clean_labels(marked: DataFrame, config: Config = Config(), pixel_area: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """All components of the opened and closed mask, and those of at least the least area."""
    c = config.postprocessing
    pixels = marked.where("mask").select("row", "col")
    pixels = stencil.closing(stencil.opening(pixels, c.opening_radius_px, marked), c.closing_radius_px, marked)
    pixels = pixels.join(marked.where("valid"), ["row", "col"], "left_semi")
    every = regions.components(pixels, config.polygons.connectivity)
    return every, regions.keep_large(every, max(1, math.ceil(c.min_mapping_unit_m2 / pixel_area)))


def with_evidence(table: DataFrame, labels: DataFrame, pair: DataFrame, config: Config = Config(), pixel: float = 0.5) -> DataFrame:
    """Adds width, length, extent, elongation and the share of edge pixels of the before scene."""
    boxes = regions.rectangles(labels, pixel)
    edges = stencil.sobel(pair.withColumn("lum", F.coalesce(P.luminance(*detect.BEFORE), F.lit(0.0))), "lum")
    edge = labels.select("label", "row", "col").join(edges, ["row", "col"]).groupBy("label").agg(F.avg((F.col("gradient") > config.tagging.misregistration_edge_threshold).cast("double")).alias("edge"))
    return table.drop("elongation", "width", "edge").join(boxes, "label").join(edge, "label")


def change_report(pair: DataFrame, config: Config = Config(), pixel: float = 0.5) -> DataFrame:
    """Smoothing, threshold, opening and closing, components, least area, attributes, tags, severity, review, ids."""
    marked = marked_scores(pair, config)
    _, labels = clean_labels(marked, config, pixel * pixel)
    table = with_evidence(region_table(pair, labels, rgb_deltas, marked.select("threshold").limit(1), pixel, marked.drop("threshold", "mask")), labels, pair, config, pixel)
    out = rules.review(rules.severity(rules.tag(table, config.tagging), config.severity))
    return regions.change_ids(out).select("change_id", "label", "pixel_count", "area", "change_magnitude", "confidence", "compactness", "elongation", "type_tag", "tags", "base_severity", "severity_tier", "review_reasons", "quality_flag")

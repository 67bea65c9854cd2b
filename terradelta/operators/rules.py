"""Tags, severity tiers, review reasons, routing and gates, as CASE projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Routing, Severity, Tagging


def tag_flags(t: Tagging = Tagging(), policy: str = "high_res_rgb", alignment: str = "pass", shift: float = 0.0) -> dict[str, Column]:
    """The tags' conditions over compactness, area, elongation, width, edge, nodata, iou, d_veg, d_built, d_lum, in order of precedence."""
    c = F.col
    built = F.coalesce(c("d_built") > t.built_rise_threshold, F.lit(False)) | F.coalesce(c("d_lum") > t.brightness_rise_threshold, F.lit(False))  # an index that isn't there shows no rise
    diffuse = (c("compactness") < t.max_compactness_diffuse) | (c("area") >= t.fluctuation_min_area_m2)
    fluctuation = (F.abs("d_veg") >= t.veg_drop_threshold) & diffuse & ~built
    thin = (c("elongation") >= t.misregistration_min_elongation) & (c("edge") >= t.misregistration_edge_threshold) & (c("width") <= (shift + 1) * t.misregistration_width_factor_px)
    return {
        "low_quality": c("nodata") >= t.low_quality_nodata_fraction,
        "misregistration_suspect": thin,
        "model_disagreement": F.coalesce(c("iou") < t.disagreement_iou_threshold, F.lit(False)),
        "vegetation_conversion": (c("d_veg") < -t.veg_drop_threshold) & (built | ((c("compactness") >= t.min_compactness_building) & ~fluctuation)),
        "vegetation_fluctuation": fluctuation,
        "building_like": F.lit(policy == "high_res_rgb") & (c("compactness") >= t.min_compactness_building) & c("area").between(t.min_building_area_m2, t.max_building_area_m2),
        "built_up_patch": F.lit(policy == "multispectral_coarse") & built,
        "alignment_suspect": F.lit(alignment in ("warn", "fail")),
    }


def tag(regions: DataFrame, t: Tagging = Tagging(), policy: str = "high_res_rgb", alignment: str = "pass", shift: float = 0.0) -> DataFrame:
    """Adds type_tag, the first tag by precedence, and tags, all of them sorted."""
    flags = tag_flags(t, policy, alignment, shift)
    name = lambda k: F.lit("misregistration_suspect" if k == "alignment_suspect" else k)
    each = F.array(*[F.when(F.coalesce(f, F.lit(False)), name(k)) for k, f in flags.items()])
    found = F.filter(each, lambda x: x.isNotNull())
    named = F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)
    return regions.withColumn("type_tag", F.element_at(named, 1)).withColumn("tags", F.array_join(F.array_sort(F.array_distinct(named)), ";"))


def severity(regions: DataFrame, s: Severity = Severity(), hits: str | None = None) -> DataFrame:
    """Adds base_severity from confidence and area, by absolute limits or percentiles of area, raised one tier by a context hit."""
    cc, mc, ca, ma = s.limits()
    out = regions
    if s.area_rule == "percentile":
        few = F.count(F.lit(1)) >= s.min_polygons_for_percentile
        limits = regions.agg(F.when(few, F.percentile("area", s.percentile_critical / 100)).otherwise(ca).alias("_ca"), F.when(few, F.percentile("area", s.percentile_medium / 100)).otherwise(ma).alias("_ma"))
        out = out.crossJoin(F.broadcast(limits))
        ca, ma = F.col("_ca"), F.col("_ma")
    tier = F.when((F.col("confidence") >= cc) & (F.col("area") >= ca), "Critical").when((F.col("confidence") >= mc) & (F.col("area") >= ma), "Medium").otherwise("Low")
    if hits:
        tier = F.when(F.col(hits) > 0, F.when(tier == "Low", "Medium").otherwise("Critical")).otherwise(tier)
    return out.withColumn("base_severity", tier).drop("_ca", "_ma")


def review(regions: DataFrame, alignment: str = "pass", override: bool = False, implausible: Column | None = None) -> DataFrame:
    """Adds severity_tier (Review if there is any reason), review_reasons in order and quality_flag."""
    has = lambda k: F.array_contains(F.split("tags", ";"), k)
    align = F.lit("alignment_override") if override else F.lit(f"alignment_{alignment}") if alignment in ("warn", "fail") else F.lit(None).cast("string")
    reasons = [align, *[F.when(has(k), f"tag_{k}") for k in ("misregistration_suspect", "low_quality", "model_disagreement")], F.when(implausible if implausible is not None else F.lit(False), "implausible_change")]
    out = regions.withColumn("review_reasons", F.array_join(F.filter(F.array(*reasons), lambda x: x.isNotNull()), ";"))
    some = F.col("review_reasons") != ""
    return out.withColumn("severity_tier", F.when(some, "Review").otherwise(F.col("base_severity"))).withColumn("quality_flag", F.when(some, F.col("review_reasons")).otherwise("nominal"))


def route(gsd: Column, bands: Column, indices: Column, r: Routing = Routing()) -> Column:
    """The policy from pixel size, band count and whether the band map supports an index."""
    return F.when((gsd <= r.high_res_max_gsd_m) & (bands >= 3), "high_res_rgb").when(gsd.between(r.coarse_min_gsd_m, r.coarse_max_gsd_m) & indices, "multispectral_coarse").otherwise("fallback")


def alignment_status(magnitude: Column, spread: Column, windows: Column, warn: float = 0.5, fail: float = 2.0, wide: float = 1.0, least: int = 2) -> Column:
    return F.when(windows < least, "unknown").when(magnitude >= fail, "fail").when((magnitude >= warn) | (spread > wide), "warn").otherwise("pass")

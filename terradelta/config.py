"""Settings of a change run: frozen records made from one table, with a rule for each value that has limits."""

from __future__ import annotations

from dataclasses import field, fields, is_dataclass, make_dataclass

# Sections, names and defaults of the settings files that users bring along.
DEFAULTS = {
    "detection": {
        "max_bands": 3, "uint8_scale": 255.0, "uint16_scale": 10000.0, "smoothing_sigma_px": 1.0, "threshold_method": "otsu", "fixed_threshold": 0.15,
        "percentile": 95.0, "otsu_floor": 0.05, "tile_size": 1024, "radiometric_normalization": False, "radiometric_norm_method": "mean_std",
    },
    "validation": {"min_valid_fraction": 0.01, "min_overlap_fraction": 0.99, "grid_tolerance_px": 0.001, "gsd_rel_tolerance": 0.01},
    "postprocessing": {"opening_radius_px": 1, "closing_radius_px": 2, "min_mapping_unit_m2": 25.0},
    "polygons": {"connectivity": 8, "simplify_tolerance_px": 0.5},
    "alignment": {
        "warn_px": 0.5, "fail_px": 2.0, "upsample_factor": 20, "n_windows": 9, "window_size_px": 128, "texture_threshold": 0.02, "min_windows": 2,
        "spread_warn_px": 1.0, "block_on_fail": True, "auto_correct": False, "interpolation": "linear",
    },
    "routing": {"high_res_max_gsd_m": 2.0, "coarse_min_gsd_m": 5.0, "coarse_max_gsd_m": 30.0},
    "bands": {"band_map": {}, "vegetation_proxy_exg": True},
    "tagging": {
        "min_compactness_building": 0.35, "min_building_area_m2": 20.0, "max_building_area_m2": 2500.0, "veg_drop_threshold": 0.15, "built_rise_threshold": 0.08,
        "brightness_rise_threshold": 0.06, "fluctuation_min_area_m2": 200.0, "max_compactness_diffuse": 0.40, "misregistration_edge_threshold": 0.20,
        "misregistration_min_elongation": 2.5, "misregistration_width_factor_px": 2.5, "low_quality_nodata_fraction": 0.15, "disagreement_iou_threshold": 0.40,
    },
    "severity": {
        "mode": "emergency", "area_rule": "absolute", "min_polygons_for_percentile": 10, "percentile_critical": 90.0, "percentile_medium": 60.0,
        "emergency_crit_conf": 0.60, "emergency_med_conf": 0.50, "emergency_critical_area_m2": 500.0, "emergency_medium_area_m2": 100.0,
        "enforcement_crit_conf": 0.85, "enforcement_med_conf": 0.75, "enforcement_critical_area_m2": 1000.0, "enforcement_medium_area_m2": 200.0,
        "implausible_change_fraction": 0.20, "implausible_change_fraction_emergency": 0.20, "implausible_change_fraction_enforcement": 0.20, "context_layers": [],
    },
}

CHOICES = {
    "detection.threshold_method": ("otsu", "fixed", "percentile"),
    "detection.radiometric_norm_method": ("mean_std", "robust"),
    "polygons.connectivity": (4, 8),
    "alignment.interpolation": ("nearest", "linear", "spline"),
    "severity.mode": ("emergency", "enforcement"),
    "severity.area_rule": ("absolute", "percentile"),
}
#: Least values, which are allowed themselves.
LEAST = {
    "detection.max_bands": 1, "detection.tile_size": 16, "detection.smoothing_sigma_px": 0, "detection.otsu_floor": 0, "postprocessing.opening_radius_px": 0,
    "postprocessing.closing_radius_px": 0, "postprocessing.min_mapping_unit_m2": 0, "polygons.simplify_tolerance_px": 0, "validation.min_valid_fraction": 0,
    "alignment.warn_px": 0, "alignment.upsample_factor": 1, "alignment.n_windows": 1, "alignment.window_size_px": 16,
}
#: Values that must lie between two bounds that aren't allowed themselves.
WITHIN = {"detection.fixed_threshold": (0, 1), "detection.percentile": (0, 100), "routing.high_res_max_gsd_m": (0, float("inf")), "routing.coarse_min_gsd_m": (0, float("inf"))}
#: (smaller, larger) pairs; equal is allowed.
ORDERED = [
    ("alignment.warn_px", "alignment.fail_px"),
    ("routing.coarse_min_gsd_m", "routing.coarse_max_gsd_m"),
    ("severity.emergency_med_conf", "severity.emergency_crit_conf"),
    ("severity.enforcement_med_conf", "severity.enforcement_crit_conf"),
]


def _default(value):
    return field(default_factory=lambda: type(value)(value)) if isinstance(value, (dict, list)) else field(default=value)


def _record(name: str, values: dict, extra: dict | None = None):
    return make_dataclass(name, [(k, type(v), _default(v)) for k, v in values.items()], frozen=True, namespace={"__module__": __name__, **(extra or {})})


def _limits(self) -> tuple:
    """Critical and medium confidence, critical and medium area, of the mode."""
    return tuple(getattr(self, f"{self.mode}_{x}") for x in ("crit_conf", "med_conf", "critical_area_m2", "medium_area_m2"))


def _implausible(self) -> float:
    """The share of changed pixels that is implausible in the mode."""
    return getattr(self, f"implausible_change_fraction_{self.mode}")


Detection, Validation, Postprocessing, Polygons, Alignment, Routing, Bands, Tagging = (
    _record(k.title(), DEFAULTS[k]) for k in ("detection", "validation", "postprocessing", "polygons", "alignment", "routing", "bands", "tagging")
)
Severity = _record("Severity", DEFAULTS["severity"], {"limits": _limits, "implausible": _implausible})
SECTIONS = {k: globals()[k.title()] for k in DEFAULTS}


def broken_rules(settings) -> list[str]:
    """The settings that break a rule, each with what it should be."""

    def value(path):
        section, name = path.split(".")
        return getattr(getattr(settings, section), name)

    wrong = [f"{p} is one of {', '.join(map(str, c))}" for p, c in CHOICES.items() if value(p) not in c]
    wrong += [f"{p} is at least {x}" for p, x in LEAST.items() if not value(p) >= x]
    wrong += [f"{p} is between {a} and {b}" for p, (a, b) in WITHIN.items() if not a < value(p) < b]
    wrong += [f"{b} is at least {a}" for a, b in ORDERED if value(a) > value(b)]
    if not 0 < settings.validation.min_overlap_fraction <= 1 or settings.validation.min_valid_fraction >= 1:
        wrong.append("validation fractions are parts of one")
    return wrong


def _check(self) -> None:
    wrong = broken_rules(self)
    if wrong:
        raise ValueError("; ".join(wrong))


Config = make_dataclass("Config", [(k, c, field(default_factory=c)) for k, c in SECTIONS.items()], frozen=True, namespace={"__module__": __name__, "__post_init__": _check})


def config_of(given: dict | None, kind=Config):
    """A Config from nested dictionaries; an unknown key raises KeyError."""
    given = given or {}
    if not isinstance(given, dict):
        raise ValueError(f"settings come as a mapping, not as {type(given).__name__}")
    known = {f.name for f in fields(kind)}
    unknown = set(given) - known
    if unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    default = kind()
    return kind(**{k: config_of(v, type(getattr(default, k))) if is_dataclass(getattr(default, k)) else v for k, v in given.items()})

import random

import numpy as np
import pytest

from terradelta.config import Config, config_of
from terradelta.operators.registration import phase_shift
from terradelta.operators.regions import least_rectangle, ring_area, trace


def test_rings_enclose_exactly_the_cells():
    r = random.Random(1)
    for _ in range(60):
        cells = np.array([(i, j) for i in range(6) for j in range(6) if r.random() < 0.6] or [(0, 0)])
        rings = trace(cells)
        assert sum(map(ring_area, rings)) == len(cells)
    block = np.array([(i, j) for i in range(5) for j in range(5) if (i, j) != (2, 2)])
    assert sorted(map(ring_area, trace(block))) == [-1, 25]


def test_least_rectangle():
    assert least_rectangle(np.array([(0, 0), (0, 4), (2, 0), (2, 4), (1, 2)])) == pytest.approx((2, 4))


def test_phase_shift_recovers_moves():
    noise = np.random.default_rng(2).random((64, 64))
    for move in ((3, -2), (0, 5), (-7, 1)):
        assert phase_shift(noise, np.roll(noise, move, (0, 1))) == pytest.approx((-move[0], -move[1]), abs=0.15)


def test_config_is_strict():
    assert config_of({"severity": {"mode": "enforcement"}}).severity.limits()[2] == 1000.0
    with pytest.raises(KeyError):
        config_of({"severity": {"colour": 1}})
    with pytest.raises(ValueError):
        config_of({"polygons": {"connectivity": 5}})
    assert Config().detection.threshold_method == "otsu"
    assert config_of({"severity": {"mode": "enforcement", "implausible_change_fraction_enforcement": 0.4}}).severity.implausible() == 0.4
    for bad in ({"detection": {"tile_size": 8}}, {"detection": {"percentile": 100}}, {"alignment": {"warn_px": 3}}, {"alignment": {"interpolation": "cubic"}}, {"severity": {"emergency_med_conf": 0.9}}, {"validation": {"min_overlap_fraction": 0}}, {"severity": 3}):
        with pytest.raises(ValueError):
            config_of(bad)
    assert config_of({k: {} for k in ("detection", "validation", "postprocessing", "polygons", "alignment", "routing", "bands", "tagging", "severity")}) == Config()


def test_exact_rounding_is_that_of_python(spark):
    from terradelta.functions import pixel

    r = random.Random(5)
    values = [2.675, 0.125, 0.375, -2.675, 1.00005, 0.00005, -0.00005, 0.00004, 0.005, 0.0049, -0.015, 1234567.00015, 0.0, None] + [r.uniform(-3, 3) for _ in range(500)] + [r.randrange(-40000, 40000) / 20000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 4):
        got = [x[0] for x in df.select(pixel.exact_rounded("v", digits)).collect()]
        assert got == [None if v is None else round(v, digits) for v in values], digits

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terradelta.config import Alignment
from terradelta.operators import registration, stencil


def scene(spark, before, after, valid=None):
    h, w = before.shape
    r, c = np.indices((h, w))
    df = pd.DataFrame({"row": r.ravel(), "col": c.ravel(), **{f"{s}{i}": x.ravel() for s, x in (("b", before), ("a", after)) for i in (1, 2, 3)}, "valid": True if valid is None else valid.ravel()})
    return spark.createDataFrame(df).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})


def test_sample_windows():
    assert registration.sample_windows(100, 80, 128, 9) == [(0, 0, 80, 100)]
    got = registration.sample_windows(256, 200, 128, 9)
    assert len(got) == 9 and got[0] == (0, 0, 128, 128) and got[-1] == (72, 128, 128, 128) and got[4] == (36, 64, 128, 128)
    assert len(registration.sample_windows(999, 999, 128, 5)) == 5


def smooth_noise(n, seed):
    spectrum = np.fft.fft2(np.random.default_rng(seed).random((n, n)))
    f = np.fft.fftfreq(n)
    g = np.fft.ifft2(spectrum * np.exp(-80 * (f[:, None] ** 2 + f[None] ** 2))).real
    return (g - g.min()) / np.ptp(g)


def test_gate_and_correction(spark):
    a = Alignment(window_size_px=64, n_windows=4, texture_threshold=0.002)  # the noise is smooth
    before = smooth_noise(96, 1)
    pair = scene(spark, before, np.roll(before, (3, -2), (0, 1)))
    found = registration.estimate_alignment(pair, 96, 96, a, 0.5)
    assert (found["shift_row_px"], found["shift_col_px"]) == pytest.approx((-3, 2), abs=0.15)
    assert found["status"] == "fail" and found["n_windows_used"] == 4 and found["shift_m"] == pytest.approx(np.hypot(3, 2) / 2, abs=0.1)
    fixed = registration.corrected(pair, found["shift_row_px"], found["shift_col_px"])
    left = registration.estimate_alignment(fixed, 96, 96, a)
    assert left["status"] == "pass" and left["magnitude_px"] < 0.4
    flat = scene(spark, np.full((96, 96), 0.4), np.full((96, 96), 0.4))
    assert registration.estimate_alignment(flat, 96, 96, a)["status"] == "unknown"


def test_cubic_shift_restores_smooth_functions(spark):
    r, c = np.indices((40, 40))
    f = lambda y, x: 0.5 + 0.2 * np.sin(y / 5) * np.cos(x / 4)
    pair = scene(spark, f(r, c), f(r, c))
    out = stencil.shifted(pair, ["a1"], 1.25, -0.5, "cubic").where("a1 is not null and row between 8 and 30 and col between 8 and 30").toPandas()
    assert len(out) == 23 * 23
    assert np.abs(out["a1"] - f(out["row"] - 1.25, out["col"] + 0.5)).max() < 1e-3
    same = stencil.shifted(pair, ["a1"], 2.0, 0.0, "cubic").where("a1 is not null").toPandas()
    assert np.abs(same["a1"] - f(same["row"] - 2, same["col"]))[(same["row"] > 15) & (same["row"] < 30) & (same["col"] > 13) & (same["col"] < 26)].max() < 2e-6

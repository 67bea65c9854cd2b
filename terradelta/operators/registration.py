"""Sub-pixel shifts by phase correlation, one window of pixels a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Alignment
from . import stencil


def phase_shift(before: np.ndarray, after: np.ndarray, upsample: int = 20) -> tuple[float, float]:
    """The (row, col) shift to apply to ``after``: whitened cross power, its peak, then a matrix transform around the peak."""
    spectrum = np.fft.fft2(before) * np.conj(np.fft.fft2(after))
    spectrum /= np.maximum(np.abs(spectrum), 100 * np.finfo(float).eps)
    peak = np.unravel_index(np.abs(np.fft.ifft2(spectrum)).argmax(), before.shape)
    shift = np.array([p - n if p > n // 2 else p for p, n in zip(peak, before.shape)], float)
    if upsample > 1:
        near = np.arange(-int(np.ceil(0.75 * upsample)), int(np.ceil(0.75 * upsample)) + 1) / upsample
        axes = [np.exp(2j * np.pi * np.outer(shift[i] + near, np.fft.fftfreq(n))) for i, n in enumerate(before.shape)]
        fine = np.abs(axes[0] @ spectrum @ axes[1].T)
        i, j = np.unravel_index(fine.argmax(), fine.shape)
        shift += [near[i], near[j]]
    return float(shift[0]), float(shift[1])


def window_shifts(pair: DataFrame, size: int = 128, upsample: int = 20) -> DataFrame:
    """win_row, win_col, n, d_row, d_col of every full window of luminance; only valid pixels count, others are zero."""
    lum = lambda s: F.when(F.col("valid"), 0.2989 * F.col(f"{s}1") + 0.5870 * F.col(f"{s}2") + 0.1140 * F.col(f"{s}3")).otherwise(0.0)
    px = pair.select((F.col("row") / size).cast("int").alias("win_row"), (F.col("col") / size).cast("int").alias("win_col"), "row", "col", lum("b").alias("b"), lum("a").alias("a"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grids = []
        r, c = pdf["row"].to_numpy() - pdf["row"].min(), pdf["col"].to_numpy() - pdf["col"].min()
        for name in ("b", "a"):
            g = np.zeros((r.max() + 1, c.max() + 1))
            g[r, c] = pdf[name]
            grids.append(g)
        d = phase_shift(*grids, upsample)
        return pd.DataFrame({"win_row": [pdf["win_row"].iloc[0]], "win_col": [pdf["win_col"].iloc[0]], "n": [len(pdf)], "d_row": [round(d[0], 6)], "d_col": [round(d[1], 6)]})

    return px.groupBy("win_row", "win_col").applyInPandas(run, "win_row int, win_col int, n long, d_row double, d_col double")


def sample_windows(width: int, height: int, size: int, wanted: int) -> list[tuple[int, int, int, int]]:
    """(row0, col0, height, width) of up to ``wanted`` windows on an even grid, row-major; a scene that fits in one is one."""
    w, h = min(size, width), min(size, height)
    if w >= width and h >= height:
        return [(0, 0, height, width)]
    steps = math.ceil(math.sqrt(wanted))
    starts = lambda room: np.linspace(0, room, steps, dtype=int).tolist()
    return [(r, c, h, w) for r in starts(height - h) for c in starts(width - w)][:wanted]


def _gradient(g: np.ndarray) -> np.ndarray:
    """As stencil.sobel, within one window."""
    p = np.pad(g, 1, mode="symmetric")
    flat = lambda x, ax: (x.take(range(x.shape[ax] - 2), ax) + 2 * x.take(range(1, x.shape[ax] - 1), ax) + x.take(range(2, x.shape[ax]), ax)) / 4
    step = lambda x, ax: (x.take(range(2, x.shape[ax]), ax) - x.take(range(x.shape[ax] - 2), ax)) / 2
    return np.sqrt((step(flat(p, 0), 1) ** 2 + step(flat(p, 1), 0) ** 2) / 2)


def gate_shifts(pair: DataFrame, width: int, height: int, a: Alignment = Alignment()) -> DataFrame:
    """row_off, col_off, height, width, d_row, d_col, texture of the sampled windows that can be judged.

    A window counts if 85 % of its pixels are valid and the gradient of its luminance,
    stretched to 0..1 with invalid pixels at 0, varies enough at both dates."""
    windows = sample_windows(width, height, a.window_size_px, a.n_windows)
    boxes = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(h).alias("h"), F.lit(w).alias("w")) for r, c, h, w in windows])
    met = F.filter(boxes, lambda b: F.col("row").between(b["r"], b["r"] + b["h"] - 1) & F.col("col").between(b["c"], b["c"] + b["w"] - 1))
    lum = lambda s: F.coalesce(0.2989 * F.col(f"{s}1") + 0.5870 * F.col(f"{s}2") + 0.1140 * F.col(f"{s}3"), F.lit(0.0)).alias(s)
    px = pair.select("row", "col", "valid", lum("b"), lum("a"), F.explode(met).alias("win"))
    px = px.select(F.col("win.r").alias("row_off"), F.col("win.c").alias("col_off"), F.col("win.h").alias("height"), F.col("win.w").alias("width"), "row", "col", "valid", "b", "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, h, w = (int(pdf[x].iloc[0]) for x in ("row_off", "col_off", "height", "width"))
        at = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        good = np.zeros((h, w), bool)
        good[at] = pdf["valid"]
        out = pd.DataFrame({x: [] for x in ("row_off", "col_off", "height", "width", "d_row", "d_col", "texture")})
        if good.mean() < 0.85:
            return out
        edges = []
        for name in ("b", "a"):
            g = np.zeros((h, w))
            g[at] = pdf[name]
            span = np.ptp(g)
            g = (g - g.min()) / span if span > 0 else np.zeros_like(g)
            g[~good] = 0
            edges.append(_gradient(g))
        texture = min(float(e[good].std()) for e in edges)
        if texture < a.texture_threshold:
            return out
        d = phase_shift(*edges, a.upsample_factor)
        return pd.DataFrame({"row_off": [r0], "col_off": [c0], "height": [h], "width": [w], "d_row": [round(d[0], 6)], "d_col": [round(d[1], 6)], "texture": [texture]})

    return px.groupBy("row_off", "col_off", "height", "width").applyInPandas(run, "row_off int, col_off int, height int, width int, d_row double, d_col double, texture double")


def estimate_alignment(pair: DataFrame, width: int, height: int, a: Alignment = Alignment(), gsd: float | None = None) -> dict:
    """Shift to apply to the after scene, its size, the windows behind it, status and reasons, from at most n_windows rows."""
    rows = [r.asDict() for r in gate_shifts(pair, width, height, a).orderBy("row_off", "col_off").collect()]
    out = {"shift_row_px": None, "shift_col_px": None, "magnitude_px": None, "shift_m": None, "spread_px": None, "n_windows_used": len(rows), "per_window_estimates": rows}
    if len(rows) < a.min_windows:
        return out | {"status": "unknown", "reasons": [f"{len(rows)} windows can be judged, {a.min_windows} are needed"]}
    d = np.array([(r["d_row"], r["d_col"]) for r in rows])
    middle = np.median(d, axis=0)
    size, spread = float(np.hypot(*middle)), float(np.hypot(*(d - middle).T).std())
    reasons = []
    if size >= a.warn_px:
        reasons.append(f"the scenes are {size:.2f} px apart")
    if spread > a.spread_warn_px:
        reasons.append(f"windows disagree by {spread:.2f} px")
    status = "fail" if size >= a.fail_px else "warn" if reasons else "pass"
    return out | {"shift_row_px": float(middle[0]), "shift_col_px": float(middle[1]), "magnitude_px": size, "shift_m": size * gsd if gsd else None, "spread_px": spread, "status": status, "reasons": reasons}


def corrected(pair: DataFrame, d_row: float, d_col: float, method: str = "linear") -> DataFrame:
    """The pair with the after bands moved; pixels whose source lies outside or is invalid become invalid."""
    after = [c for c in pair.columns if c[0] == "a" and c[1:].isdigit()]
    moved = stencil.shifted(pair.withColumns({c: F.when(F.col("valid"), F.coalesce(c, F.lit(0.0))) for c in after}), after, d_row, d_col, method)
    out = pair.drop(*after).join(moved, ["row", "col"])
    return out.withColumn("valid", F.col("valid") & F.col(after[0]).isNotNull()).withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in after}).select(*pair.columns)


def alignment_summary(shifts: DataFrame) -> DataFrame:
    """One row: median shift, its magnitude, the spread around it and the number of windows."""
    middle = shifts.agg(F.median("d_row").alias("d_row"), F.median("d_col").alias("d_col"))
    far = shifts.select(F.col("d_row").alias("r"), F.col("d_col").alias("c")).crossJoin(F.broadcast(middle))
    return far.groupBy("d_row", "d_col").agg(F.count(F.lit(1)).alias("windows"), F.stddev_pop(F.hypot(F.col("r") - F.col("d_row"), F.col("c") - F.col("d_col"))).alias("spread")).withColumn("magnitude", F.hypot("d_row", "d_col"))

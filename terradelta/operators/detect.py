"""Scores, radiometric matching and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P

BEFORE, AFTER = ["b1", "b2", "b3"], ["a1", "a2", "a3"]


def rms_scores(pair: DataFrame, bands: int = 3) -> DataFrame:
    """Adds score, over the first bands: rounded, so that comparisons with a threshold don't depend on summation order."""
    return pair.withColumn("score", F.when(F.col("valid"), F.round(P.rms(BEFORE[:bands], AFTER[:bands]), 6)).otherwise(0.0))


def spectral_scores(pair: DataFrame, band_map: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """Adds d_<index> of every index the band map (name -> number) supports and score, the root mean square of their halves; and the indices."""
    side = lambda s: {name: f"{s}{i}" for name, i in band_map.items()}
    have = [n for n in ("ndvi", "ndbi", "mndwi", "exg") if P.spectral_index(n, side("b"))[0] is not None]
    if not have:
        raise ValueError(f"bands {sorted(band_map)} support no spectral index")
    out = pair.withColumns({f"d_{n}": F.when(F.col("valid"), P.spectral_index(n, side("a"))[0] - P.spectral_index(n, side("b"))[0]).otherwise(0.0) for n in have})
    return out.withColumn("score", F.when(F.col("valid"), F.round(P.index_rms([f"d_{n}" for n in have]), 6)).otherwise(0.0)), have


def match_mean_std(pair: DataFrame) -> DataFrame:
    """The after bands with mean and deviation of the before bands, over valid pixels."""
    good = pair.where("valid")
    stats = good.agg(*[f(c).alias(f"{n}_{c}") for c in BEFORE + AFTER for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = pair.crossJoin(F.broadcast(stats))  # one row
    for b, a in zip(BEFORE, AFTER):
        matched = (F.col(a) - F.col(f"m_{a}")) * F.col(f"s_{b}") / F.greatest(F.col(f"s_{a}"), F.lit(1e-4)) + F.col(f"m_{b}")
        out = out.withColumn(a, P.normalise(matched))
    return out.select(*pair.columns)


def median_mad(pair: DataFrame, iterations: int = 2) -> DataFrame:
    """One row: median and scaled MAD of each band; later passes leave out pixels of large difference."""
    good, keep = pair.where("valid"), None
    for _ in range(iterations):
        now = good if keep is None else keep
        med = now.agg(*[F.median(c).alias(f"m_{c}") for c in BEFORE + AFTER])
        dev = now.crossJoin(F.broadcast(med)).agg(*[F.first(f"m_{c}").alias(f"m_{c}") for c in BEFORE + AFTER], *[F.greatest(1.4826 * F.median(F.abs(F.col(c) - F.col(f"m_{c}"))), F.lit(1e-4)).alias(f"d_{c}") for c in BEFORE + AFTER])
        diff = sum(F.abs((F.col(a) - F.col(f"m_{a}")) * F.col(f"d_{b}") / F.col(f"d_{a}") + F.col(f"m_{b}") - F.col(b)) for b, a in zip(BEFORE, AFTER)) / len(BEFORE)
        scored = good.crossJoin(F.broadcast(dev)).withColumn("diff", F.round(diff, 9))
        cut = scored.agg(F.percentile("diff", 0.8).alias("cut"))
        keep = scored.crossJoin(F.broadcast(cut)).where("diff <= cut").select(*pair.columns)
    return dev


def match_robust(pair: DataFrame) -> DataFrame:
    out = pair.crossJoin(F.broadcast(median_mad(pair)))
    for b, a in zip(BEFORE, AFTER):
        out = out.withColumn(a, P.normalise((F.col(a) - F.col(f"m_{a}")) * F.col(f"d_{b}") / F.col(f"d_{a}") + F.col(f"m_{b}")))
    return out.select(*pair.columns)


def otsu(scores: DataFrame, floor: float = 0.05, bins: int = 256) -> DataFrame:
    """One row, threshold: the bin centre that separates two classes best, and at least floor."""
    span = scores.where("valid").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    binned = scores.where("valid").crossJoin(F.broadcast(span)).select("low", width.alias("width"), F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) / width))).otherwise(0).cast("int").alias("bin"))
    # 256 rows from here on
    count = binned.groupBy("bin", "low", "width").agg(F.count(F.lit(1)).alias("n")).withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * F.col("width"))
    up, rest = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    s = count.withColumns({"w1": F.sum("n").over(up), "s1": F.sum(F.col("n") * F.col("centre")).over(up), "w2": F.sum("n").over(rest), "s2": F.sum(F.col("n") * F.col("centre")).over(rest)})
    s = s.withColumn("between", F.round(F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2"), 2), 6))
    best = F.max_by("centre", F.struct(F.col("between"), (-F.col("bin")).alias("first")))
    return s.where("w2 is not null").agg(best.alias("centre")).select(F.round(F.greatest(F.coalesce("centre", F.lit(floor)), F.lit(floor)), 6).alias("threshold"))


def threshold(scores: DataFrame, method: str = "percentile", value: float = 0.8, floor: float = 0.05) -> DataFrame:
    """One row, threshold: fixed value, exact percentile of valid scores (0..1), or Otsu's."""
    if method == "fixed":
        return scores.sparkSession.range(1).select(F.lit(float(value)).alias("threshold"))
    if method == "percentile":
        return scores.where("valid").agg(F.round(F.percentile("score", float(value)), 6).alias("threshold"))
    return otsu(scores, floor)


def change_mask(scores: DataFrame, method: str = "percentile", value: float = 0.8) -> DataFrame:
    return scores.crossJoin(F.broadcast(threshold(scores, method, value))).withColumn("mask", F.col("valid") & (F.col("score") >= F.col("threshold")))

"""The registered queries of the raster operators and their SQL twins.

The driver's tables hold no rasters, so the queries run on a scene made of lineitem
(see ``sources.scenes``), on embeddings, labels and small tables of constants.  The
SQL side states each query anew for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Severity
from ..functions import pixel as P
from ..functions import projection
from ..operators import detect, regions, registration, rules, stencil, vectors
from ..sources import scenes
from . import change

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


SCENE = """dims AS (SELECT CAST(ceil(sqrt(max(l_partkey) + 1)) AS BIGINT) AS w, max(l_partkey) AS last FROM lineitem),
cells AS (SELECT l_partkey AS cell,
 avg(CASE WHEN l_returnflag = 'A' AND l_shipdate < TIMESTAMP '1998-06-01' THEN l_quantity END) / 50 AS b1,
 avg(CASE WHEN l_returnflag = 'N' AND l_shipdate < TIMESTAMP '1998-06-01' THEN l_quantity END) / 50 AS b2,
 avg(CASE WHEN l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1998-06-01' THEN l_quantity END) / 50 AS b3,
 avg(CASE WHEN l_returnflag = 'A' AND NOT l_shipdate < TIMESTAMP '1998-06-01' THEN l_quantity END) / 50 AS a1,
 avg(CASE WHEN l_returnflag = 'N' AND NOT l_shipdate < TIMESTAMP '1998-06-01' THEN l_quantity END) / 50 AS a2,
 avg(CASE WHEN l_returnflag = 'R' AND NOT l_shipdate < TIMESTAMP '1998-06-01' THEN l_quantity END) / 50 AS a3
 FROM lineitem GROUP BY 1),
grid AS (SELECT unnest(generate_series(0, (last // w + 1) * w - 1)) AS cell, w FROM dims),
pair AS (SELECT CAST(cell // w AS INT) AS row, CAST(cell % w AS INT) AS col, b1, b2, b3, a1, a2, a3,
 (b1 + b2 + b3 + a1 + a2 + a3) IS NOT NULL AS valid FROM grid LEFT JOIN cells USING (cell)),
scores AS (SELECT *, CASE WHEN valid THEN round(sqrt((pow(a1 - b1, 2) + pow(a2 - b2, 2) + pow(a3 - b3, 2)) / 3), 6) ELSE 0.0 END AS score FROM pair),
size AS (SELECT max(row) + 1 AS height, max(col) + 1 AS width FROM pair)"""

MASK = SCENE + """,
thr AS (SELECT round(quantile_cont(score, 0.8), 6) AS threshold FROM scores WHERE valid),
mask AS (SELECT row, col, score FROM scores, thr WHERE valid AND score >= threshold)"""


def _labels(connectivity: int) -> str:
    near = "abs(n.row - r.row) <= 1 AND abs(n.col - r.col) <= 1" if connectivity == 8 else "abs(n.row - r.row) + abs(n.col - r.col) = 1"
    return (
        MASK.replace("dims AS", "RECURSIVE dims AS", 1)
        + f""",
reach AS (SELECT row, col, row * 2147483648 + col AS label FROM mask
 UNION SELECT n.row, n.col, r.label FROM reach r JOIN mask n ON {near} AND r.label < n.row * 2147483648 + n.col),
labels AS (SELECT row, col, CAST(min(label) AS BIGINT) AS label FROM reach GROUP BY 1, 2)"""
    )


LABELS = _labels(4)
KEPT = LABELS + ",\nkept AS (SELECT * FROM labels WHERE label IN (SELECT label FROM labels GROUP BY 1 HAVING count(*) >= 3))"
EDGES = (
    KEPT
    + """,
sides AS (SELECT * FROM (VALUES ('N', -1, 0), ('S', 1, 0), ('W', 0, -1), ('E', 0, 1)) t(side, dr, dc)),
edges AS (SELECT k.label, k.row, k.col, side FROM kept k, sides s WHERE NOT EXISTS (SELECT 1 FROM kept n WHERE n.label = k.label AND n.row = k.row + dr AND n.col = k.col + dc))"""
)
SHAPES = (
    EDGES
    + """,
rim AS (SELECT label, count(*) * 0.5 AS perimeter FROM edges GROUP BY 1),
shapes AS (SELECT label, count(*) AS pixel_count, round(avg(row + 0.5), 6) AS centre_row, round(avg(col + 0.5), 6) AS centre_col, any_value(perimeter) AS perimeter,
 count(*) * 0.25 AS area, round(least(1.0, 4 * pi() * (count(*) * 0.25) / pow(any_value(perimeter), 2)), 4) AS compactness FROM kept JOIN rim USING (label) GROUP BY 1)"""
)

pair = scenes.order_scene


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.rms_scores(pair(spark, sf_dir))


def mask(spark, sf_dir) -> DataFrame:
    return detect.change_mask(scores(spark, sf_dir), "percentile", 0.8).where("mask")


def kept(spark, sf_dir) -> DataFrame:
    return regions.keep_large(regions.components(mask(spark, sf_dir), 4), 3)


# sources and pixels


@query(f"WITH {SCENE} SELECT row, col, round(b1, 9) b1, round(b2, 9) b2, round(b3, 9) b3, round(a1, 9) a1, round(a2, 9) a2, round(a3, 9) a3, valid FROM pair")
def scene_pair(spark, sf_dir):
    return pair(spark, sf_dir).select("row", "col", *[F.round(c, 9).alias(c) for c in detect.BEFORE + detect.AFTER], "valid")


@query("WITH g AS (SELECT unnest(generate_series(0, 11)) AS i) SELECT CAST(i // 4 * 256 AS INT) row0, CAST(i % 4 * 256 AS INT) col0, CAST(least(256, 700 - i // 4 * 256) AS INT) h, CAST(least(256, 1000 - i % 4 * 256) AS INT) w FROM g")
def tile_grid(spark, sf_dir):
    return scenes.tile_grid(spark, 1000, 700, 256)


@query(f"WITH {SCENE} SELECT CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 9) AS valid_fraction, round(stddev_pop(b1), 9) AS spread_b1, stddev_pop(b1) < 1e-9 AS is_constant, bool_or(isinf(b1) OR isnan(b1)) AS has_nonfinite FROM pair")
def valid_fraction(spark, sf_dir):
    bad = F.isnan("b1") | (F.abs("b1") == float("inf"))
    return pair(spark, sf_dir).agg(F.sum(F.col("valid").cast("long")).alias("n_valid"), F.round(F.avg(F.col("valid").cast("double")), 9).alias("valid_fraction"), F.round(F.stddev_pop("b1"), 9).alias("spread_b1"), (F.stddev_pop("b1") < 1e-9).alias("is_constant"), F.bool_or(bad).alias("has_nonfinite"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, coalesce(l_quantity, 0) / 40)), 9) AS value FROM lineitem")
def normalise_pixels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(P.normalise("l_quantity", 40.0), 9).alias("value"))


@query(f"WITH {SCENE} SELECT row, col, valid, score FROM scores")
def rms_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("row", "col", "valid", "score")


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(generate_series(1, 32), lambda i: pow(CAST(embedding[i + 32] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 2))) / 32), 6) AS score FROM embeddings")
def many_band_rms(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    b, a = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    total = F.aggregate(F.zip_with(b, a, lambda x, y: F.pow(y.cast("double") - x.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", "label", F.round(F.sqrt(total / 32), 6).alias("score"))


@query(
    f"WITH {SCENE}, s AS (SELECT "
    + ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in detect.BEFORE + detect.AFTER)
    + " FROM pair WHERE valid) SELECT row, col, "
    + ", ".join(f"CASE WHEN a{i} IS NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, (a{i} - m_a{i}) * s_b{i} / greatest(s_a{i}, 1e-4) + m_b{i})), 6) END AS a{i}" for i in (1, 2, 3))
    + " FROM pair, s"
)
def radiometric_mean_std(spark, sf_dir):
    return detect.match_mean_std(pair(spark, sf_dir)).select("row", "col", *[F.round(c, 6).alias(c) for c in detect.AFTER])


_MAD0 = "m0 AS (SELECT " + ", ".join(f"median({c}) m_{c}" for c in detect.BEFORE + detect.AFTER) + " FROM pair WHERE valid), d0 AS (SELECT " + ", ".join(f"any_value(m_{c}) m_{c}, greatest(1.4826 * median(abs({c} - m_{c})), 1e-4) d_{c}" for c in detect.BEFORE + detect.AFTER) + " FROM pair, m0 WHERE valid)"
_DIFF = "round((" + " + ".join(f"abs((a{i} - m_a{i}) * d_b{i} / d_a{i} + m_b{i} - b{i})" for i in (1, 2, 3)) + ") / 3, 9)"


@query(
    f"WITH {SCENE}, {_MAD0}, f AS (SELECT pair.*, {_DIFF} AS diff FROM pair, d0 WHERE valid), k AS (SELECT * FROM f WHERE diff <= (SELECT quantile_cont(diff, 0.8) FROM f)), "
    + "m1 AS (SELECT " + ", ".join(f"median({c}) m_{c}" for c in detect.BEFORE + detect.AFTER) + " FROM k) SELECT "
    + ", ".join(f"round(any_value(m_{c}), 6) m_{c}, round(greatest(1.4826 * median(abs({c} - m_{c})), 1e-4), 6) d_{c}" for c in detect.BEFORE + detect.AFTER)
    + " FROM k, m1"
)
def radiometric_robust(spark, sf_dir):
    out = detect.median_mad(pair(spark, sf_dir))
    return out.select(*[F.round(f"{k}_{c}", 6).alias(f"{k}_{c}") for c in detect.BEFORE + detect.AFTER for k in ("m", "d")])


def _nd(x, y):
    return f"CASE WHEN abs({x} + {y}) > 1e-6 THEN greatest(-1.0, least(1.0, ({x} - {y}) / ({x} + {y}))) ELSE 0.0 END"


BANDS = {"red": 1, "nir": 2, "swir1": 3, "green": 2, "blue": 3}
_INDEX_SQL = {n: ({"ndvi": lambda s: _nd(f"{s}2", f"{s}1"), "ndbi": lambda s: _nd(f"{s}3", f"{s}2"), "mndwi": lambda s: _nd(f"{s}2", f"{s}3"), "exg": lambda s: f"greatest(-1.0, least(1.0, (2 * {s}2 - {s}1 - {s}3) / 2))"}[n]) for n in ("ndvi", "ndbi", "mndwi", "exg")}


def _deltas(df: DataFrame) -> DataFrame:
    side = lambda s: {n: f"{s}{i}" for n, i in BANDS.items()}
    return df.withColumns({f"d_{n}": F.when(F.col("valid"), F.round(P.spectral_index(n, side("a"))[0] - P.spectral_index(n, side("b"))[0], 6)).otherwise(0.0) for n in _INDEX_SQL})


_DELTA_SQL = ", ".join(f"CASE WHEN valid THEN round(({f('a')}) - ({f('b')}), 6) ELSE 0.0 END AS d_{n}" for n, f in _INDEX_SQL.items())


@query(f"WITH {SCENE} SELECT row, col, {_DELTA_SQL} FROM pair")
def spectral_indices(spark, sf_dir):
    return _deltas(pair(spark, sf_dir)).select("row", "col", *[f"d_{n}" for n in _INDEX_SQL])


@query(f"WITH {SCENE}, d AS (SELECT row, col, {_DELTA_SQL} FROM pair) SELECT row, col, round(sqrt((pow(abs(d_ndvi) / 2, 2) + pow(abs(d_ndbi) / 2, 2) + pow(abs(d_mndwi) / 2, 2) + pow(abs(d_exg) / 2, 2)) / 4), 6) AS score FROM d")
def spectral_rms(spark, sf_dir):
    return _deltas(pair(spark, sf_dir)).select("row", "col", F.round(P.index_rms([f"d_{n}" for n in _INDEX_SQL]), 6).alias("score"))


@query(f"WITH {SCENE}, l AS (SELECT row, col, 0.2989 * b1 + 0.5870 * b2 + 0.1140 * b3 AS lb, 0.2989 * a1 + 0.5870 * a2 + 0.1140 * a3 AS la FROM pair WHERE valid) SELECT row, col, round(la - lb, 6) AS d_lum FROM l")
def luminance_delta(spark, sf_dir):
    return pair(spark, sf_dir).where("valid").select("row", "col", F.round(P.luminance(*detect.AFTER) - P.luminance(*detect.BEFORE), 6).alias("d_lum"))


@query(f"WITH {SCENE}, p AS (SELECT quantile_cont(v, 0.02) lo, quantile_cont(v, 0.98) hi FROM (SELECT b1 v FROM pair WHERE valid UNION ALL SELECT a1 FROM pair WHERE valid)) SELECT row, col, round(greatest(0.0, least(1.0, (b1 - lo) / greatest(hi - lo, 1e-9))), 6) AS b1, round(greatest(0.0, least(1.0, (a1 - lo) / greatest(hi - lo, 1e-9))), 6) AS a1 FROM pair, p WHERE valid")
def contrast_stretch(spark, sf_dir):
    px = pair(spark, sf_dir).where("valid")
    cut = px.select(F.col("b1").alias("v")).unionByName(px.select(F.col("a1").alias("v"))).agg(F.percentile("v", 0.02).alias("lo"), F.percentile("v", 0.98).alias("hi"))
    return px.crossJoin(F.broadcast(cut)).select("row", "col", *[F.round(P.clip((F.col(c) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)), 0.0, 1.0), 6).alias(c) for c in ("b1", "a1")])


@query(f"WITH {SCENE} SELECT row, col, CAST(floor(greatest(0.0, least(1.0, (score - 0.2) / 0.8)) * 255) AS INT) r, CAST(floor(greatest(0.0, 1 - abs(score - 0.5) * 2) * 220) AS INT) g, CAST(floor(greatest(0.0, least(1.0, (0.6 - score) / 0.6)) * 255) AS INT) b, CAST(CASE WHEN score > 0.1 THEN floor(greatest(0.2, least(0.8, score)) * 255) ELSE 0 END AS INT) alpha FROM scores")
def heatmap_rgba(spark, sf_dir):
    names = ("r", "g", "b", "alpha")
    return scores(spark, sf_dir).select("row", "col", *[c.alias(n) for c, n in zip(P.heat_rgba("score"), names)])


@query(f"WITH {SCENE} SELECT CAST(row // 3 AS INT) AS row, CAST(col // 3 AS INT) AS col, count(*) AS n, round(avg(score), 6) AS score FROM scores GROUP BY 1, 2")
def decimate(spark, sf_dir):
    at = lambda c: F.floor(F.col(c) / 3).cast("int").alias(c)
    return scores(spark, sf_dir).groupBy(at("row"), at("col")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query(f"WITH {SCENE}, o AS (SELECT greatest(1.0, greatest(height, width) / 12.0) AS step, height, width FROM size), rs AS (SELECT CAST(floor((i + 0.5) * step) AS INT) AS row FROM o, generate_series(0, 11) t(i) WHERE i < floor(height / step + 1e-9)), cs AS (SELECT CAST(floor((i + 0.5) * step) AS INT) AS col FROM o, generate_series(0, 11) t(i) WHERE i < floor(width / step + 1e-9)) SELECT row, col, score FROM scores JOIN rs USING (row) JOIN cs USING (col)")
def decimate_nearest(spark, sf_dir):
    s = scores(spark, sf_dir)
    height, width = s.agg(F.max("row") + 1, F.max("col") + 1).first()
    return scenes.sampled(s, height, width, 12).select("row", "col", "score")


@query(f"WITH {MASK} SELECT s.row, s.col, CASE WHEN valid THEN s.score ELSE -9999.0 END AS score, CAST(CASE WHEN NOT valid THEN 255 WHEN s.score >= threshold THEN 1 ELSE 0 END AS INT) AS mask FROM scores s, thr")
def mask_encoding(spark, sf_dir):
    m = detect.change_mask(scores(spark, sf_dir), "percentile", 0.8)
    return m.select("row", "col", F.when(F.col("valid"), F.col("score")).otherwise(-9999.0).alias("score"), F.when(~F.col("valid"), 255).otherwise(F.col("mask").cast("int")).alias("mask"))


@query("SELECT c_custkey, CAST((CASE WHEN c_acctbal >= 0 THEN 32600 ELSE 32700 END) + (CAST(floor((((c_custkey * 7) % 360) - 180 + 180) / 6) AS BIGINT) % 60) + 1 AS INT) AS epsg FROM customer")
def utm_zone(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", P.utm_epsg((F.col("c_custkey") * 7) % 360 - 180, F.col("c_acctbal")).alias("epsg"))


AFFINE = (0.5, 0.0, 500000.0, 0.0, -0.5, 4500000.0)


@query(f"WITH {SCENE} SELECT row, col, 0.5 * col + 500000.0 AS x, -0.5 * row + 4500000.0 AS y, CAST(row AS DOUBLE) AS back_row, CAST(col AS DOUBLE) AS back_col FROM pair")
def affine_roundtrip(spark, sf_dir):
    x, y = P.to_world("row", "col", AFFINE)
    world = pair(spark, sf_dir).select("row", "col", x.alias("x"), y.alias("y"))
    r, c = P.to_pixel("x", "y", AFFINE)
    return world.select("row", "col", "x", "y", r.alias("back_row"), c.alias("back_col"))


# thresholds


@query(f"WITH {SCENE} SELECT count(*) AS n, round(sum(score), 4) AS total FROM scores WHERE valid AND score >= 0.15")
def threshold_fixed(spark, sf_dir):
    return detect.change_mask(scores(spark, sf_dir), "fixed", 0.15).where("mask").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {MASK} SELECT threshold, count(*) AS n FROM mask, thr GROUP BY 1")
def threshold_percentile(spark, sf_dir):
    return mask(spark, sf_dir).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


OTSU = """span AS (SELECT min(score) lo, max(score) hi FROM scores WHERE valid),
bins AS (SELECT CAST(CASE WHEN hi > lo THEN least(255, floor((score - lo) / ((hi - lo) / 256))) ELSE 0 END AS INT) bin, lo, (hi - lo) / 256 AS wide, count(*) n FROM scores, span WHERE valid GROUP BY 1, 2, 3),
c AS (SELECT bin, n, lo + (bin + 0.5) * wide AS centre FROM bins),
cum AS (SELECT *, sum(n) OVER (ORDER BY bin) w1, sum(n * centre) OVER (ORDER BY bin) s1, sum(n) OVER (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) w2, sum(n * centre) OVER (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) s2 FROM c),
otsu AS (SELECT round(greatest(centre, 0.05), 6) AS threshold FROM cum WHERE w2 IS NOT NULL ORDER BY round(w1 * w2 * pow(s1 / w1 - s2 / w2, 2), 6) DESC, bin LIMIT 1)"""


@query(f"WITH {SCENE}, {OTSU} SELECT threshold FROM otsu")
def threshold_otsu(spark, sf_dir):
    return detect.otsu(scores(spark, sf_dir))


@query(f"WITH {SCENE}, {OTSU}, m AS (SELECT 'fixed' AS method, 0.15 AS threshold UNION ALL SELECT 'otsu', threshold FROM otsu UNION ALL SELECT 'percentile', round(quantile_cont(score, 0.95), 6) FROM scores WHERE valid) SELECT method, round(CAST(threshold AS DOUBLE), 6) AS threshold, count(*) AS n FROM m JOIN scores ON valid AND score >= threshold GROUP BY 1, 2")
def threshold_sweep(spark, sf_dir):
    s = scores(spark, sf_dir)
    each = [detect.change_mask(s, m, v).where("mask").groupBy(F.lit(m).alias("method"), F.round("threshold", 6).alias("threshold")).agg(F.count(F.lit(1)).alias("n")) for m, v in (("fixed", 0.15), ("otsu", 0), ("percentile", 0.95))]
    return each[0].unionByName(each[1]).unionByName(each[2])


# stencils


def _reflect(x, n):
    x = f"({x})"
    return f"(CASE WHEN {x} < 0 THEN -1 - {x} WHEN {x} >= {n} THEN 2 * {n} - 1 - {x} ELSE {x} END)"


_W = ", ".join(f"({i - 4}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(stencil.gaussian_weights(1.0)))


@query(
    f"""WITH {SCENE}, k AS (SELECT * FROM (VALUES {_W}) t(o, w)),
v AS (SELECT s.row, s.col, sum(w * CASE WHEN n.valid THEN n.score ELSE 0 END) num, sum(w * CASE WHEN n.valid THEN 1.0 ELSE 0 END) den FROM scores s, size, k JOIN scores n ON n.col = s.col AND n.row = {_reflect('s.row + o', 'height')} GROUP BY 1, 2),
h AS (SELECT v.row, v.col, sum(w * n.num) num, sum(w * n.den) den FROM v, size, k JOIN v n ON n.row = v.row AND n.col = {_reflect('v.col + o', 'width')} GROUP BY 1, 2)
SELECT s.row, s.col, CASE WHEN valid AND den > 1e-6 THEN round(num / den, 6) ELSE 0.0 END AS score FROM h JOIN scores s USING (row, col)"""
)
def gaussian_smooth(spark, sf_dir):
    return stencil.smooth(scores(spark, sf_dir), 1.0).select("row", "col", "score")


@query(
    f"""WITH {SCENE}, o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(o)), kk AS (SELECT r.o dr, c.o dc, CASE r.o WHEN 0 THEN 0.5 ELSE 0.25 END * c.o / 2.0 AS wx, CASE c.o WHEN 0 THEN 0.5 ELSE 0.25 END * r.o / 2.0 AS wy FROM o r, o c),
g AS (SELECT s.row, s.col, sum(wx * n.score) gx, sum(wy * n.score) gy FROM scores s, size, kk JOIN scores n ON n.row = {_reflect('s.row + dr', 'height')} AND n.col = {_reflect('s.col + dc', 'width')} GROUP BY 1, 2)
SELECT row, col, round(sqrt((gx * gx + gy * gy) / 2), 6) AS gradient FROM g"""
)
def sobel_edges(spark, sf_dir):
    return stencil.sobel(scores(spark, sf_dir), "score").select("row", "col", "gradient")


_DISK1 = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(dr, dc)"


def _spread_sql(source):
    return f"SELECT m.row + dr AS row, m.col + dc AS col FROM {source} m, {_DISK1}"


def _dilate_sql(source):
    return f"SELECT DISTINCT row, col FROM ({_spread_sql(source)}), size WHERE row >= 0 AND col >= 0 AND row < height AND col < width"


def _erode_sql(source):
    return f"SELECT row, col FROM ({_spread_sql(source)}) GROUP BY 1, 2 HAVING count(*) = 5"


@query(f"WITH {MASK.replace('score, 0.8', 'score, 0.3')}, e AS ({_erode_sql('mask')}) {_dilate_sql('e')}")
def binary_opening(spark, sf_dir):
    wide = detect.change_mask(scores(spark, sf_dir), "percentile", 0.3).where("mask")
    return stencil.opening(wide.select("row", "col"), 1, pair(spark, sf_dir))


@query(f"WITH {MASK}, d AS ({_dilate_sql('mask')}) {_erode_sql('d')}")
def binary_closing(spark, sf_dir):
    return stencil.closing(mask(spark, sf_dir).select("row", "col"), 1, pair(spark, sf_dir))


@query(f"WITH {SCENE} SELECT s.row, s.col, round(n.score, 9) AS score FROM scores s LEFT JOIN scores n ON n.row = s.row - 2 AND n.col = s.col + 1")
def shift_nearest(spark, sf_dir):
    return stencil.shifted(scores(spark, sf_dir), ["score"], 2.0, -1.0)


@query(f"WITH {SCENE} SELECT s.row, s.col, round(0.75 * n.score + 0.25 * m.score, 9) AS score FROM scores s LEFT JOIN scores n ON n.row = s.row - 1 AND n.col = s.col LEFT JOIN scores m ON m.row = s.row - 2 AND m.col = s.col")
def shift_linear(spark, sf_dir):
    return stencil.shifted(scores(spark, sf_dir), ["score"], 1.25, 0.0, "linear")


# components and regions


@query(f"WITH {LABELS} SELECT * FROM labels")
def components_4(spark, sf_dir):
    return regions.components(mask(spark, sf_dir), 4, 16)


@query(f"WITH {_labels(8)} SELECT * FROM labels")
def components_8(spark, sf_dir):
    return regions.components(mask(spark, sf_dir), 8, 16)


@query(f"WITH {KEPT} SELECT * FROM kept")
def mmu_filter(spark, sf_dir):
    return kept(spark, sf_dir)


@query(f"WITH {KEPT} SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(b1), 6) AS mean_b1, round(avg(a1), 6) AS mean_a1 FROM kept JOIN scores USING (row, col) GROUP BY 1")
def zonal_stats(spark, sf_dir):
    return regions.zonal(kept(spark, sf_dir), scores(spark, sf_dir), ["score", "b1", "a1"])


@query(f"WITH {EDGES} SELECT * FROM edges")
def exposed_edges(spark, sf_dir):
    return regions.exposed_edges(kept(spark, sf_dir))


@query(f"WITH {SHAPES} SELECT label, pixel_count, centre_row, centre_col, perimeter, area, compactness FROM shapes")
def region_shape(spark, sf_dir):
    return regions.shapes(kept(spark, sf_dir)).select("label", "pixel_count", "centre_row", "centre_col", "perimeter", "area", "compactness")


@query(f"WITH {KEPT} SELECT label, row, col, dense_rank() OVER (ORDER BY label) AS number FROM kept")
def label_numbers(spark, sf_dir):
    return regions.numbered(kept(spark, sf_dir)).select("label", "row", "col", F.col("number").cast("long").alias("number"))


@query(
    f"""WITH {KEPT}, v AS (SELECT label, row + dr AS vr, col + dc AS vc, count(*) AS n, count(DISTINCT dr) = 2 AND count(DISTINCT dc) = 2 AND count(*) = 2 AS across FROM kept, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dr, dc) GROUP BY 1, 2, 3),
q AS (SELECT label, count(*) FILTER (WHERE n = 1) AS q1, count(*) FILTER (WHERE n = 3) AS q3, count(*) FILTER (WHERE across) AS qd FROM v GROUP BY 1), n AS (SELECT label, CAST(count(*) AS DOUBLE) AS area_px FROM kept GROUP BY 1)
SELECT label, CAST(2 - (q1 - q3 + 2 * qd) // 4 AS BIGINT) AS n_rings, CAST(1 - (q1 - q3 + 2 * qd) // 4 AS BIGINT) AS n_holes, CAST(q1 + q3 + 2 * qd AS BIGINT) AS n_corners, area_px FROM q JOIN n USING (label)"""
)
def ring_counts(spark, sf_dir):
    """Rings, holes, corners and area of the traced polygons; the SQL side counts the corner patterns of two by two pixels."""
    return regions.polygons(kept(spark, sf_dir)).drop("rings")


@query()
def rings(spark, sf_dir):
    return regions.polygons(kept(spark, sf_dir))


@query()
def min_rotated_rect(spark, sf_dir):
    return regions.rectangles(kept(spark, sf_dir))


@query(f"WITH {SHAPES} SELECT label, area, format('CHG-{{:04d}}', row_number() OVER (ORDER BY area DESC, label)) AS change_id FROM shapes")
def region_ids(spark, sf_dir):
    return regions.change_ids(regions.shapes(kept(spark, sf_dir))).select("label", "area", "change_id")


@query(f"WITH {SHAPES} SELECT label, area FROM shapes WHERE area >= 2")
def area_filter(spark, sf_dir):
    return regions.shapes(kept(spark, sf_dir)).where("area >= 2").select("label", "area")


@query(f"WITH {KEPT}, other AS (SELECT row, col FROM scores WHERE valid AND score >= 0.3), t AS (SELECT count(*) AS n_other FROM other), i AS (SELECT label, count(*) n, count(o.row) AS hit FROM kept LEFT JOIN other o USING (row, col) GROUP BY 1) SELECT label, round(hit / (n + n_other - hit), 6) AS iou FROM i, t")
def model_disagreement(spark, sf_dir):
    return change.overlap(kept(spark, sf_dir), scores(spark, sf_dir).where("valid and score >= 0.3")).select("label", F.round("iou", 6).alias("iou"))


@query(f"WITH {KEPT}, ref AS (SELECT row, col FROM scores WHERE valid AND b1 < 0.5) SELECT round(coalesce(sum(0.25), 0), 4) AS false_alarm_area FROM kept WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.row = kept.row AND r.col = kept.col)")
def false_alarm_area(spark, sf_dir):
    ref = scores(spark, sf_dir).where("valid and b1 < 0.5")
    return kept(spark, sf_dir).join(ref, ["row", "col"], "left_anti").agg(F.round(F.count(F.lit(1)) * 0.25, 4).alias("false_alarm_area"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 9) AS precision, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 9) AS recall, round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 1 OR toxic = 1), 0), 9) AS iou FROM labels")
def pixel_metrics(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("quality") == 1).alias("pred"), (F.col("toxic") == 1).alias("ref"))
    return change.confusion(rows).select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "iou")])


@query(f"WITH {MASK}, o AS (SELECT row, col FROM scores WHERE valid AND b1 < 0.5) SELECT row, col, 'both' AS kind FROM mask JOIN o USING (row, col) UNION ALL SELECT row, col, 'first' FROM mask ANTI JOIN o USING (row, col) UNION ALL SELECT row, col, 'second' FROM o ANTI JOIN mask USING (row, col)")
def mask_setops(spark, sf_dir):
    a, b = mask(spark, sf_dir).select("row", "col"), scores(spark, sf_dir).where("valid and b1 < 0.5").select("row", "col")
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    return kind(a.intersect(b), "both").unionByName(kind(a.exceptAll(b), "first")).unionByName(kind(b.exceptAll(a), "second"))


# rules


_REGION = (
    SHAPES
    + f""",
delta AS (SELECT row, col, score, {_DELTA_SQL}, (0.2989 * a1 + 0.5870 * a2 + 0.1140 * a3) - (0.2989 * b1 + 0.5870 * b2 + 0.1140 * b3) AS d_lum FROM scores),
facts AS (SELECT label, round(avg(score), 4) AS change_magnitude, round(avg(greatest(0.0, least(1.0, (score - threshold) / greatest(1 - threshold, 1e-6)))), 4) AS confidence, round(avg(d_ndvi), 12) AS d_veg, round(avg(d_ndbi), 12) AS d_built, round(avg(d_lum), 12) AS d_lum FROM (SELECT label, row, col FROM kept) JOIN delta USING (row, col), thr GROUP BY 1),
region AS (SELECT * FROM shapes JOIN facts USING (label))"""
)


def _region_table(spark, sf_dir):
    limit = detect.threshold(scores(spark, sf_dir), "percentile", 0.8)
    return change.region_table(pair(spark, sf_dir), kept(spark, sf_dir), _deltas, limit)


@query(f"WITH {_REGION} SELECT label, area, compactness, change_magnitude, confidence, d_veg, d_built, d_lum FROM region")
def region_attributes(spark, sf_dir):
    return _region_table(spark, sf_dir).select("label", "area", "compactness", "change_magnitude", "confidence", "d_veg", "d_built", "d_lum")


_TAGS = """flags AS (SELECT *, (d_built > 0.08 OR d_lum > 0.06) AS built, abs(d_veg) >= 0.15 AND (compactness < 0.40 OR area >= 200) AND NOT (d_built > 0.08 OR d_lum > 0.06) AS fluct FROM region),
tagged AS (SELECT *, list_filter([CASE WHEN d_veg < -0.15 AND (built OR (compactness >= 0.35 AND NOT fluct)) THEN 'vegetation_conversion' END, CASE WHEN fluct THEN 'vegetation_fluctuation' END, CASE WHEN compactness >= 0.35 AND area >= 20 AND area <= 2500 THEN 'building_like' END], lambda x: x IS NOT NULL) AS found FROM flags)"""


@query(f"WITH {_REGION}, {_TAGS} SELECT label, CASE WHEN len(found) = 0 THEN 'unknown' ELSE found[1] END AS type_tag, CASE WHEN len(found) = 0 THEN 'unknown' ELSE array_to_string(list_sort(found), ';') END AS tags FROM tagged")
def tag_regions(spark, sf_dir):
    return rules.tag(_region_table(spark, sf_dir)).select("label", "type_tag", "tags")


@query(f"WITH {KEPT} SELECT label, round(avg(sqrt((pow(a1 - b1, 2) + pow(a2 - b2, 2) + pow(a3 - b3, 2)) / 3)), 12) AS chroma, round(avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END), 6) AS nodata FROM kept JOIN scores USING (row, col) GROUP BY 1")
def region_evidence(spark, sf_dir):
    return _region_table(spark, sf_dir).select("label", "chroma", F.round("nodata", 6).alias("nodata"))


_MADE = {
    "compactness": "p_partkey * 37 % 100 / 100", "area": "p_partkey * 91 % 3000 / 1", "elongation": "(10 + p_partkey * 13 % 50) / 10", "width": "p_partkey * 7 % 60 / 10", "edge": "p_partkey * 17 % 50 / 100",
    "nodata": "p_partkey * 29 % 40 / 100", "iou": "p_partkey * 31 % 100 / 100", "d_veg": "(p_partkey * 53 % 60 - 30) / 100", "d_built": "(p_partkey * 59 % 30 - 15) / 100", "d_lum": "(p_partkey * 61 % 30 - 15) / 100",
}


def _made(spark, sf_dir):
    each = [F.expr(f"CAST(({x.rsplit(' / ', 1)[0]}) AS double) / CAST({x.rsplit(' / ', 1)[1]} AS double)").alias(n) for n, x in _MADE.items()]
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *each)


@query(
    "WITH m AS (SELECT p_partkey, policy, " + ", ".join(f"CAST(({x.rsplit(' / ', 1)[0]}) AS DOUBLE) / CAST({x.rsplit(' / ', 1)[1]} AS DOUBLE) AS {n}" for n, x in _MADE.items()) + """ FROM part, (VALUES ('high_res_rgb'), ('multispectral_coarse')) p(policy)),
f AS (SELECT *, d_built > 0.08 OR d_lum > 0.06 AS built, abs(d_veg) >= 0.15 AND (compactness < 0.40 OR area >= 200) AND NOT (d_built > 0.08 OR d_lum > 0.06) AS fluct FROM m),
t AS (SELECT *, list_filter([CASE WHEN nodata >= 0.15 THEN 'low_quality' END, CASE WHEN elongation >= 2.5 AND edge >= 0.20 AND width <= 3.75 THEN 'misregistration_suspect' END, CASE WHEN iou < 0.40 THEN 'model_disagreement' END,
 CASE WHEN d_veg < -0.15 AND (built OR (compactness >= 0.35 AND NOT fluct)) THEN 'vegetation_conversion' END, CASE WHEN fluct THEN 'vegetation_fluctuation' END,
 CASE WHEN policy = 'high_res_rgb' AND compactness >= 0.35 AND area >= 20 AND area <= 2500 THEN 'building_like' END, CASE WHEN policy = 'multispectral_coarse' AND built THEN 'built_up_patch' END], lambda x: x IS NOT NULL) AS found FROM f)
SELECT p_partkey, policy, CASE WHEN len(found) = 0 THEN 'unknown' ELSE found[1] END AS type_tag, CASE WHEN len(found) = 0 THEN 'unknown' ELSE array_to_string(list_sort(found), ';') END AS tags,
 array_to_string(list_filter([CASE policy WHEN 'high_res_rgb' THEN 'alignment_warn' ELSE 'alignment_override' END, CASE WHEN list_contains(found, 'misregistration_suspect') THEN 'tag_misregistration_suspect' END, CASE WHEN list_contains(found, 'low_quality') THEN 'tag_low_quality' END,
 CASE WHEN list_contains(found, 'model_disagreement') THEN 'tag_model_disagreement' END, CASE WHEN p_partkey % 2 = 0 THEN 'implausible_change' END], lambda x: x IS NOT NULL), ';') AS review_reasons FROM t"""
)
def tag_cases(spark, sf_dir):
    """Tags and review reasons of made evidence, under both policies."""
    made, odd = _made(spark, sf_dir).withColumn("base_severity", F.lit("Low")), F.col("p_partkey") % 2 == 0
    each = [rules.review(rules.tag(made, policy=p, shift=0.5), "warn", o, odd).withColumn("policy", F.lit(p)) for p, o in (("high_res_rgb", False), ("multispectral_coarse", True))]
    return each[0].unionByName(each[1]).select("p_partkey", "policy", "type_tag", "tags", "review_reasons")


@query("WITH d AS (SELECT CAST(s_suppkey * 13 % 7 - 3 AS DOUBLE) r, round(s_acctbal / 2000, 3) c FROM supplier), m AS (SELECT median(r) mr, median(c) mc FROM d) SELECT round(any_value(mr), 6) AS d_row, round(any_value(mc), 6) AS d_col, count(*) AS windows, round(stddev_pop(sqrt(pow(r - mr, 2) + pow(c - mc, 2))), 6) AS spread, round(sqrt(pow(any_value(mr), 2) + pow(any_value(mc), 2)), 6) AS magnitude FROM d, m")
def shift_summary(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 13 % 7 - 3).cast("double").alias("d_row"), F.round(F.col("s_acctbal") / 2000, 3).alias("d_col"))
    return registration.alignment_summary(d).select("windows", *[F.round(c, 6).alias(c) for c in ("d_row", "d_col", "spread", "magnitude")])


CASES = "(VALUES (1, 50.0, 0.4), (2, 250.0, 0.55), (3, 600.0, 0.65), (4, 1500.0, 0.9), (5, 500.0, 0.6), (6, 100.0, 0.5), (7, 2000.0, 0.3), (8, 1000.0, 0.85), (9, 200.0, 0.75), (10, 99.9, 0.99)) t(id, area, confidence)"


def _cases(spark):
    return spark.sql(f"SELECT id, CAST(area AS double) area, CAST(confidence AS double) confidence FROM {CASES}")


def _tier(cc, mc, ca, ma):
    return f"CASE WHEN confidence >= {cc} AND area >= {ca} THEN 'Critical' WHEN confidence >= {mc} AND area >= {ma} THEN 'Medium' ELSE 'Low' END"


@query(f"SELECT id, {_tier(0.60, 0.50, 500, 100)} AS base_severity FROM {CASES}")
def severity_emergency(spark, sf_dir):
    return rules.severity(_cases(spark)).select("id", "base_severity")


@query(f"SELECT id, {_tier(0.85, 0.75, 1000, 200)} AS base_severity FROM {CASES}")
def severity_enforcement(spark, sf_dir):
    return rules.severity(_cases(spark), Severity(mode="enforcement")).select("id", "base_severity")


@query(f"WITH p AS (SELECT quantile_cont(CAST(area AS DOUBLE), 0.9) ca, quantile_cont(CAST(area AS DOUBLE), 0.6) ma FROM {CASES}) SELECT id, {_tier(0.60, 0.50, 'ca', 'ma')} AS base_severity FROM {CASES}, p")
def severity_percentile(spark, sf_dir):
    return rules.severity(_cases(spark), Severity(area_rule="percentile")).select("id", "base_severity")


@query(f"WITH s AS (SELECT id, area, {_tier(0.60, 0.50, 500, 100)} AS t FROM {CASES}) SELECT id, CASE WHEN id % 2 = 0 THEN CASE t WHEN 'Low' THEN 'Medium' ELSE 'Critical' END ELSE t END AS base_severity FROM s")
def severity_context(spark, sf_dir):
    return rules.severity(_cases(spark).withColumn("hits", (F.col("id") % 2 == 0).cast("int")), hits="hits").select("id", "base_severity")


@query(f"SELECT id, 'alignment_warn' || CASE WHEN id % 3 = 0 THEN ';tag_low_quality' ELSE '' END AS review_reasons, 'Review' AS severity_tier FROM {CASES}")
def review_override(spark, sf_dir):
    tagged = rules.severity(_cases(spark)).withColumn("tags", F.when(F.col("id") % 3 == 0, "building_like;low_quality").otherwise("unknown"))
    return rules.review(tagged, "warn").select("id", "review_reasons", "severity_tier")


@query(f"WITH {MASK} SELECT round((SELECT count(*) FROM mask) / count(*), 6) AS changed_fraction, (SELECT count(*) FROM mask) / count(*) > 0.2 AS implausible FROM scores WHERE valid")
def implausible_change(spark, sf_dir):
    m = detect.change_mask(scores(spark, sf_dir), "percentile", 0.8).where("valid").agg(F.avg(F.col("mask").cast("double")).alias("f"))
    return m.select(F.round("f", 6).alias("changed_fraction"), (F.col("f") > 0.2).alias("implausible"))


@query("SELECT p_partkey, CASE WHEN p_size / 2.0 <= 2 AND p_partkey % 4 + 1 >= 3 THEN 'high_res_rgb' WHEN p_size / 2.0 >= 5 AND p_size / 2.0 <= 30 AND p_partkey % 2 = 0 THEN 'multispectral_coarse' ELSE 'fallback' END AS policy FROM part")
def route_inputs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", rules.route(F.col("p_size") / 2, F.col("p_partkey") % 4 + 1, F.col("p_partkey") % 2 == 0).alias("policy"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN 'unknown' WHEN p_size / 20.0 >= 2.0 THEN 'fail' WHEN p_size / 20.0 >= 0.5 OR p_retailprice / 1000 > 1.0 THEN 'warn' ELSE 'pass' END AS status FROM part")
def alignment_status(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", rules.alignment_status(F.col("p_size") / 20, F.col("p_retailprice") / 1000, F.col("p_partkey") % 5).alias("status"))


BOXES = "(VALUES (1, 0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (2, 0.0, 0.0, 4.0, 4.0, 0.0, 0.0, 40.0, 40.0), (3, 0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0)) t(id, w1, s1, e1, n1, w2, s2, e2, n2)"


@query(f"SELECT id, round(CAST(greatest(0, least(e1, e2) - greatest(w1, w2)) * greatest(0, least(n1, n2) - greatest(s1, s2)) / least((e1 - w1) * (n1 - s1), (e2 - w2) * (n2 - s2)) AS DOUBLE), 6) AS overlap FROM {BOXES}")
def bbox_overlap(spark, sf_dir):
    b = spark.sql(f"SELECT id, {', '.join(f'CAST({c} AS double) {c}' for c in 'w1 s1 e1 n1 w2 s2 e2 n2'.split())} FROM {BOXES}")
    return b.select("id", F.round(change.bbox_overlap([F.col(c) for c in ("w1", "s1", "e1", "n1")], [F.col(c) for c in ("w2", "s2", "e2", "n2")]), 6).alias("overlap"))


@query("SELECT substr(sha256(sha256(CAST(o_orderkey AS VARCHAR)) || sha256(o_orderstatus)), 1, 12) AS pair_id, o_orderkey FROM orders")
def pair_id(spark, sf_dir):
    both = F.concat(F.sha2(F.col("o_orderkey").cast("string"), 256), F.sha2("o_orderstatus", 256))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.substring(F.sha2(both, 256), 1, 12).alias("pair_id"), "o_orderkey")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def review_upsert(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_type", "value")


@query(f"WITH {SHAPES} SELECT (SELECT count(*) FROM mask) AS n_mask, (SELECT count(DISTINCT label) FROM labels) AS n_components, count(*) AS n_regions, round(sum(area), 4) AS total_area FROM shapes")
def run_counts(spark, sf_dir):
    m = mask(spark, sf_dir)
    lab = regions.components(m, 4)
    one = m.agg(F.count(F.lit(1)).alias("n_mask")).crossJoin(lab.agg(F.countDistinct("label").alias("n_components")))
    return one.crossJoin(regions.shapes(regions.keep_large(lab, 3)).agg(F.count(F.lit(1)).alias("n_regions"), F.round(F.sum("area"), 4).alias("total_area")))


@query()
def phase_shift(spark, sf_dir):
    """The shift of a synthetic pair whose buildings moved by three columns."""
    return registration.window_shifts(scenes.synthetic_scene(spark, 256, 3), 128)


@query()
def alignment_report(spark, sf_dir):
    s = registration.alignment_summary(registration.window_shifts(scenes.synthetic_scene(spark, 256, 3), 128))
    return s.withColumn("status", rules.alignment_status(F.col("magnitude"), F.col("spread"), F.col("windows")))


@query()
def synthetic_change(spark, sf_dir):
    """The whole run on a generated scene of known areas."""
    return change.change_report(scenes.synthetic_scene(spark, 256), pixel=1.0)


_FULL_TIER = "CASE WHEN confidence >= 0.6 AND area >= 500 THEN 'Critical' WHEN confidence >= 0.5 AND area >= 100 THEN 'Medium' ELSE 'Low' END"


@query(
    f"WITH {_REGION}, {_TAGS} SELECT format('CHG-{{:04d}}', row_number() OVER (ORDER BY area DESC, label)) AS change_id, label, pixel_count, area, confidence, compactness, "
    f"CASE WHEN len(found) = 0 THEN 'unknown' ELSE found[1] END AS type_tag, {_FULL_TIER} AS severity_tier FROM tagged"
)
def full_pipeline(spark, sf_dir):
    """Scores, mask, components, least area, attributes, tags, severity and ids of the lineitem scene."""
    table = _region_table(spark, sf_dir)
    out = rules.review(rules.severity(rules.tag(table)))
    return regions.change_ids(out).select("change_id", "label", "pixel_count", "area", "confidence", "compactness", "type_tag", "severity_tier")


# polygons and places


def world_polygons(spark, sf_dir) -> DataFrame:
    return regions.polygons(kept(spark, sf_dir)).withColumn("rings", vectors.world_rings("rings", AFFINE))


@query(f"WITH {KEPT} SELECT label, count(*) * 0.25 AS area_m2, round(500000 + 0.5 * avg(col + 0.5), 3) AS centroid_x, round(4500000 - 0.5 * avg(row + 0.5), 3) AS centroid_y FROM kept GROUP BY 1")
def polygon_area(spark, sf_dir):
    """Area and centroid of the traced rings, which must be those of the pixels."""
    out = vectors.metric_attributes(world_polygons(spark, sf_dir), 32633)
    return out.select("label", "area_m2", F.round("centroid_x", 3).alias("centroid_x"), F.round("centroid_y", 3).alias("centroid_y"))


@query()
def simplified_polygons(spark, sf_dir):
    out = vectors.simplify(world_polygons(spark, sf_dir), 0.25)
    return out.select("label", "n_corners", F.size(F.flatten("rings")).cast("long").alias("n_kept"), F.round(vectors.area("rings"), 6).alias("area_m2"))


_LON, _LAT = "(c_custkey * 37 % 600) / 100.0 + 12", "(c_custkey * 91 % 14000) / 100.0 - 70"
_XI = "xi" + "".join(f" + {a:.17e} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(projection.ALPHA, 1))
_ETA = "eta" + "".join(f" + {a:.17e} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(projection.ALPHA, 1))


@query(
    f"""WITH p AS (SELECT c_custkey, CAST({_LON} AS DOUBLE) lon, CAST({_LAT} AS DOUBLE) lat FROM customer),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {projection.ECC:.17e} * atanh({projection.ECC:.17e} * sin(radians(lat)))) t, radians(lon - 15) l FROM p),
e AS (SELECT *, atan2(t, cos(l)) xi, atanh(sin(l) / sqrt(1 + t * t)) eta FROM t)
SELECT c_custkey, round(500000 + {projection.SCALE * projection.RADIUS:.17e} * ({_ETA}), 3) AS x, round({projection.SCALE * projection.RADIUS:.17e} * ({_XI}), 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM e"""
)
def utm_roundtrip(spark, sf_dir):
    at = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", f"CAST({_LON} AS double) lon", f"CAST({_LAT} AS double) lat")
    x, y = projection.from_geographic("lon", "lat", 32633)
    out = at.select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = projection.to_geographic("x", "y", 32633)
    return out.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT s_suppkey, c_custkey FROM supplier, customer WHERE abs((c_custkey * 37 % 1000) - (s_suppkey * 53 % 1000)) <= 7 AND abs((c_custkey * 91 % 997) - (s_suppkey * 17 % 997)) <= 7")
def spatial_join(spark, sf_dir):
    """Squares of side 6 around customers that share a point with squares of side 8 around suppliers."""

    def squares(name, key, x, y, half):
        corner = lambda dx, dy: F.array((F.expr(x) + dx * half).cast("double"), (F.expr(y) + dy * half).cast("double"))
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, F.array(F.array(*[corner(*d) for d in ((-1, -1), (1, -1), (1, 1), (-1, 1))])).alias("rings"))

    one = squares("supplier", "s_suppkey", "s_suppkey * 53 % 1000", "s_suppkey * 17 % 997", 4)
    return vectors.spatial_pairs(one, squares("customer", "c_custkey", "c_custkey * 37 % 1000", "c_custkey * 91 % 997", 3), "s_suppkey", "c_custkey", 16.0)


@query(f"WITH {_REGION}, {_TAGS}, f AS (SELECT CASE WHEN len(found) = 0 THEN 'unknown' ELSE found[1] END AS type_tag, {_FULL_TIER} AS severity_tier, area FROM tagged) SELECT coalesce(severity_tier, 'all') AS severity_tier, coalesce(type_tag, 'all') AS type_tag, count(*) AS n, round(sum(area), 4) AS total_area FROM f GROUP BY ROLLUP (severity_tier, type_tag)")
def tier_report(spark, sf_dir):
    t = full_pipeline(spark, sf_dir).rollup("severity_tier", "type_tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 4).alias("total_area"))
    return t.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("severity_tier", "type_tag")})


@query()
def shift_cubic(spark, sf_dir):
    return stencil.shifted(scores(spark, sf_dir), ["score"], 1.25, -0.5, "cubic")


@query()
def alignment_gate(spark, sf_dir):
    """The judged windows of a generated pair whose buildings moved by three columns."""
    return registration.gate_shifts(scenes.synthetic_scene(spark, 256, 3), 256, 256)

"""Mixing sources to target weights by entropy balancing.

The rates r of documents nearest to "once each" in entropy, weighted by size, such
that each source's words come to its target, minimise sum size * (r log r - r + 1)
under sum size * r = target.  The solution tilts every rate exponentially,
r = exp(lambda of its source), and the convex dual separates by source:

    D(lambda) = mass * exp(lambda) - target * lambda

The masses come from one distributed aggregate over all documents; as no constraint
names two sources, the Hessian is diagonal and all sources' Newton steps
lambda -= D' / D'' run side by side on the table of sources.  As
targets stop at twice the mass, no rate exceeds two.  Rates become whole copies by
error diffusion: in groups of a source's documents, largest first, each document
gets the rate's floor or one more, whichever keeps the words taken nearest to the
rate's share so far; the error left in a group is below its smallest documents.

Defined cases: null text has size 0; null is a source of its own and the last one;
documents of size 0 take 0; a source without words has target 0; repeated rows are
rows of their own, rounded in one group; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, with_columns_of
from .kernels import word_counts

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
STEPS = 64
#: Documents in a rounding group.
GROUP = 4096
#: Sources up to which their table is broadcast; beyond, the join is one that Spark splits on skew.
SMALL = 20_000


def sizes(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """doc_id, source, size (words) of every row, and the long columns to carry."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(word_counts(b.column(2))), *b.columns[3:]], names=["doc_id", "source", "size", *carry])

    rows = with_columns_of(docs.withColumns({f"{c}_id": F.col(c) for c in carry}), "doc_id", "source", "text", *[f"{c}_id" for c in carry])
    return rows.mapInArrow(run, "doc_id long, source string, size long" + "".join(f", {c} long" for c in carry))


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: one row a source.

    Sharing an excess again by weight until none is above its limit ends at
    target = min(limit, level * weight) with one level for all; it is found by
    taking the sources in the order of limit / weight."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("own", level)
    # the level at the first source whose limit isn't reached
    free = F.min(F.when(F.col("most") > F.col("own") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("own").alias("own")))).over(whole)
    return per.withColumn("level", free["own"]).select("source", "source_size", "n_docs", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight"))).alias("target"))


def tilts(targets: DataFrame, steps: int = STEPS) -> DataFrame:
    """Adds rate = exp(lambda), lambda by Newton's method on each source's dual."""
    mass, target = F.col("source_size").cast("double"), F.col("target")
    newton = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda x, _: x - (mass * F.exp(x) - target) / (mass * F.exp(x)))
    return targets.withColumn("rate", F.when((mass > 0) & (target > 0), F.least(F.round(F.exp(newton), 12), F.lit(MOST))).otherwise(F.lit(0.0)))


def copies(size: np.ndarray, rate: float) -> np.ndarray:
    """Whole copies of documents given largest first."""
    low = int(min(np.floor(rate + 1e-9), MOST))
    part = max(0.0, rate - low)
    out = np.full(len(size), low, np.int64)
    if part <= 1e-12 or low >= MOST:
        return out
    open_words = 0.0
    for i, s in enumerate(size.tolist()):
        open_words += part * s
        if s and 2 * open_words >= s:
            out[i] += 1
            open_words -= s
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, carry: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of every row, and the long columns to carry, which order rows of one doc_id."""
    rows = cut(sizes(docs, carry))
    state = cut(tilts(source_targets(rows, weights, share)).withColumn("same", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"))
    if state.limit(SMALL + 1).count() <= SMALL:
        state = F.broadcast(state)
    rows = rows.withColumn("same", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(state, "same")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", *carry)
    salt = F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.ceil(F.col("n_docs") / GROUP))

    def round_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", *carry], ascending=[False] + [True] * (1 + len(carry)), kind="stable")
        pdf["copies"] = copies(pdf["size"].to_numpy(), float(pdf["rate"].iloc[0]))
        return pdf[["doc_id", "source", "size", "source_size", "target", "rate", "copies", *carry]]

    schema = "doc_id long, source string, size long, source_size long, target double, rate double, copies long" + "".join(f", {c} long" for c in carry)
    return rows.withColumn("salt", salt).groupBy("same", "salt").applyInPandas(round_group, schema)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")

"""Reading, partition counts and lineage cuts for the corpus operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """What the optimiser knows of the size of the input; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, each: int = 4 << 20, least: int = 1) -> int:
    """Number of groups of about ``each`` bytes of stored input, so a group's size stays the same at any scale.

    Where the optimiser has no size (it then says exabytes), the texts are measured."""
    size = input_bytes(df)
    if size >= 1 << 52:
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
        size = (df.agg(F.sum(sum(texts, F.lit(16).cast("long"))).alias("n")).first()["n"] or 0) // 2
    return max(least, math.ceil(size / each))


def with_checkpoints(spark: SparkSession) -> None:
    """Uses the shared folder of ``spark.checkpoint.dir``; only a session in one process (a test) may be without one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so lost executors lose nothing."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def with_columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one reads as null of type string (long for ids)."""
    have = {c.lower(): c for c in df.columns}
    kind = lambda n: "long" if n.endswith("_id") or n in ("turn", "n_chars") else "string"
    return df.select(*[(F.col(f"`{have[n]}`").cast(kind(n)) if n in have else F.lit(None).cast(kind(n))).alias(n) for n in names])


def id_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending values that split key into ``parts`` ranges of about as many rows; ``parts`` - 1 numbers reach the driver."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, shares, max(10_000, 8 * parts)).alias("q")).first()
    return sorted({int(x) for x in row["q"] or []})


def range_of(key, bounds: list[int]):
    """The number of bounds that are no greater than key, found over a coarse and then a fine list."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    whole, coarse = F.lit(bounds).cast("array<bigint>"), F.lit(bounds[::step]).cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda x: x <= key))
    fine = F.size(F.filter(F.slice(whole, (F.greatest(block, F.lit(1)) - 1) * step + 1, F.lit(step)), lambda x: x <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + fine)

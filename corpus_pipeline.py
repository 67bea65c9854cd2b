"""A training-data pipeline of five corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of documents.  Each row is a document of its own, whatever other rows
have its doc_id or none: decisions stay with the row, by a key made for the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import cut
from terradelta.llm.decontamination import decontaminate, is_contaminated
from terradelta.llm.mixing import mix
from terradelta.llm.pii import mask_personal_data
from terradelta.llm.simhash import simhash_components
from terradelta.llm.toxicity import fit, without_toxic


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a key, stored so that it stays the same, and the rows under that key for doc_id."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    return rows, rows.withColumn("doc_id", F.col("__row")).drop("__row")


def _with_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return rows.join(keys, "__row", how).drop("__row")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go."""
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id, rows without one last, ties by a hash of the row."""
    rows, own = _keyed(docs)
    found = simhash_components(own).select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64(*docs.columns).alias("tie"), F.col("__row"))
    ranked = rows.select("__row", order.alias("order")).join(found, "__row")
    first = ranked.groupBy("component_id").agg(F.min("order")["__row"].alias("__row")).select("__row")
    return _with_key(rows, first, "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    rows, own = _keyed(docs)
    found = decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_key(rows, found.where(is_contaminated()).select(F.col("doc_id").alias("__row")), "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text becomes its kind in brackets; n_chars follows."""
    out = mask_personal_data(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with size, source_size, target, copies (1 or 2) and taken."""
    rows, _ = _keyed(docs)
    found = mix(rows.withColumn("__tie", F.xxhash64(*docs.columns)), carry=("__tie", "__row"))
    taken = found.where("copies > 0").select("__row", "size", "source_size", "target", "copies")
    return _with_key(rows, taken, "inner").withColumn("taken", F.col("size") * F.col("copies"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("source_mixing", source_mixing),
]

#: Training a network has no SQL form; tests/llm holds the stages against brute-force versions, toxicity against the network's own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

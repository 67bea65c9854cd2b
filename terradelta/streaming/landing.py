"""Runs for pairs that arrive in a landing folder, as JSON lines (before, after, name).

The stream is stateless: each request is a run of its own, so there is no watermark.
Names are folders, so a batch that is repeated after a failure writes the same ones,
and finished runs (a provenance that says so) are skipped.
"""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.run import AlignmentError, ValidationError, run_pipeline

log = logging.getLogger(__name__)
REQUEST = "before string, after string, name string"


def finished(folder: str) -> bool:
    try:
        with open(os.path.join(folder, "provenance.json")) as f:
            return json.load(f).get("status") is not None
    except (FileNotFoundError, json.JSONDecodeError):
        return False


def run_requests(batch: DataFrame, out_root: str, config: Config = Config()) -> None:
    for r in batch.where("before is not null and after is not null and name is not null").toLocalIterator():
        if finished(os.path.join(out_root, r.name)):
            continue
        try:
            run_pipeline(batch.sparkSession, r.before, r.after, out_root, config, run_name=r.name)
        except (ValidationError, AlignmentError) as e:  # recorded in the run's provenance
            log.warning("%s: %s", r.name, e)


def watch(spark: SparkSession, landing: str, out_root: str, checkpoint: str, config: Config = Config(), **trigger) -> StreamingQuery:
    """trigger: as for DataStreamWriter.trigger, such as availableNow=True."""
    requests = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 16).json(landing)
    return requests.writeStream.foreachBatch(lambda batch, _: run_requests(batch, out_root, config)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()

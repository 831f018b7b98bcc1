"""Streaming application of rules: the same rules over files as they come, with a checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import PyRule, apply_to_json


def stream_jsonl(spark: SparkSession, source: str, rules: Sequence[PyRule], target: str, checkpoint: str) -> StreamingQuery:
    """Clean all JSON lines in ``source`` that no earlier run has read, then stop; exactly once by the checkpoint."""
    lines = spark.readStream.text(source).select(F.trim("value").alias("raw")).where("raw <> ''")
    cleaned = apply_to_json(lines, rules)
    return cleaned.writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

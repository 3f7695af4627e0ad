"""Streaming variants of the logs: memory upserts and session folds over growing files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs


def memory_stream(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour"):
    """Append new memory rows to a Parquet log. Rows that repeat an id and content within ``delay`` are written once;
    :func:`narrative_spark.operators.logs.memory` folds the log. Start the returned writer."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["character_id", "id", "content"])
    return once.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per window and kind; late rows count until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))


def session_states(batch: DataFrame) -> DataFrame:
    """The fold of one micro-batch, for ``foreachBatch``."""
    return logs.sessions(batch)

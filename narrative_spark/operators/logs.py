"""Append-only logs: memory with idempotent upserts, sessions, and model-call usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def entries(rows: DataFrame) -> DataFrame:
    """Rows to add to the memory log: an entry without an id gets one of its content; one without a character is an error."""
    given = F.nullif(F.col("id"), F.lit("")) if "id" in rows.columns else F.lit(None).cast("string")
    source = F.col("source") if "source" in rows.columns else F.lit("book")
    who = F.when(F.coalesce(F.col("character_id").cast("string"), F.lit("")) != "", F.col("character_id")).otherwise(F.raise_error(F.lit("a memory entry without a character")))
    return rows.withColumns({"character_id": who, "id": F.coalesce(given, T.content_id("mem_", F.col("character_id").cast("string"), "content", source))})


def memory(log: DataFrame) -> DataFrame:
    """The state of ``(character_id, id, seq, content)``: the last content of an id, at the place of its first.

    ``writes`` counts the rows that changed something: a repeat of the same content is none.
    """
    before = F.lag("content").over(W.partitionBy("character_id", "id").orderBy("seq"))
    changed = log.withColumn("before", before).where("before is null or before <> content")
    return changed.groupBy("character_id", "id").agg(F.max_by("content", "seq").alias("content"), F.min("seq").alias("first_seq"), F.count("*").alias("writes"))


def hits(entries: DataFrame, touches: DataFrame) -> DataFrame:
    """Entries with the number of touches; touches of unknown ids don't count."""
    n = touches.groupBy("character_id", "id").agg(F.count("*").alias("hits"))
    return entries.join(n, ["character_id", "id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def sessions(events: DataFrame) -> DataFrame:
    """``(session_id, state, n_messages, messages)`` of ``(session_id, seq, kind, state, message)``: the last state
    that isn't null, and the messages in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("seq", "message")))), lambda x: x["message"])
    return events.groupBy("session_id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("seq"))).alias("state"), F.count("message").alias("n_messages"), ordered.alias("messages"))


def usage(calls: DataFrame) -> DataFrame:
    """Totals of ``(model, ok, prompt_tokens, completion_tokens, cached_tokens)``; they can be added up."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), total("prompt_tokens"), total("completion_tokens"), total("cached_tokens"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("total_tokens"),
    )

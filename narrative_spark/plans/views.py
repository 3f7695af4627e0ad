"""What a console shows of a flow's tables: their heads, short enough to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHAPTERS, LINES, CHARS = 20, 8, 40


def chapters(rows: DataFrame, most: int = CHAPTERS) -> DataFrame:
    """The first chapters with their titles and lengths."""
    return rows.select("book_id", "chapter_index", "title", F.length("content").alias("chars")).orderBy("book_id", "chapter_index").limit(most)


def candidates(rows: DataFrame, most: int = CHAPTERS) -> DataFrame:
    """The first candidates with their counts and a context."""
    return rows.select("book_id", "rank", "name", "chapter_count", "mentions", T.preview(F.get("contexts", F.lit(0)), CHARS).alias("context")).orderBy("book_id", "rank").limit(most)


def usage(calls: DataFrame) -> DataFrame:
    return calls.orderBy("model")


def fields(now: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A character's fields, one row each."""
    each = F.array(*(F.struct(F.lit(label).alias("field"), F.col(f).alias("value")) for f, label in labels.items()))
    return now.select("book_id", "character", F.inline(each)).where("value <> ''")


def samples(rows: DataFrame, most: int = LINES) -> DataFrame:
    """The first samples of speech of each character."""
    return rows.select("book_id", "character", F.posexplode(F.slice("speech_samples", 1, most)).alias("no", "sample"))


def quotes(rows: DataFrame, most: int = LINES) -> DataFrame:
    return rows.select("book_id", "character", "field", T.preview("text", CHARS).alias("text"), "chapter_index").orderBy("book_id", "character", "chapter_index", "field", "text").limit(most)


def timeline(events: DataFrame, most: int = LINES) -> DataFrame:
    return events.where(F.col("event_order") < most).select("book_id", "character", "id", "chapter", T.preview("summary", 2 * CHARS).alias("summary")).orderBy("book_id", "character", "id")


def card(report: DataFrame, findings: DataFrame) -> DataFrame:
    """Each card's counters with the number of its findings."""
    n = findings.groupBy("name").agg(F.count("*").alias("findings"))
    return report.join(n, "name", "left").fillna(0, ["findings"]).orderBy("name")

"""Chapter observations folded into a current persona with its change history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T

KEYS = ["book_id", "character"]


def facts(increments: DataFrame) -> DataFrame:
    """``(book_id, character, chapter_index, field_no, field, value)``: one row per non-blank text field."""
    each = F.array(*(F.struct(F.lit(k).alias("field_no"), F.lit(f).alias("field"), T.strip(f).alias("value")) for k, f in enumerate(rules.FIELDS)))
    return increments.select(*KEYS, "chapter_index", F.inline(each)).where("value <> ''")


def _field_order() -> W:
    return W.partitionBy(*KEYS, "field").orderBy("chapter_index")


def change_log(found: DataFrame) -> DataFrame:
    """Rows where a field's value differs from the one before; the first has no ``previous``."""
    before = F.lag("value").over(_field_order())
    return found.withColumn("previous", before).where("previous is null or previous <> value")


def conflicts(log: DataFrame, increments: DataFrame | None = None) -> DataFrame:
    """Changes of mind: derived ones with their reason, then in each chapter those that the model itself named."""
    reason = F.format_string(rules.CONFLICT_REASON, F.col("chapter_index").cast("long"))
    derived = log.where("previous is not null").select(*KEYS, "chapter_index", F.lit(0).alias("src"), F.col("field_no").alias("pos"), "field", F.col("previous").alias("from"), F.col("value").alias("to"), reason.alias("reason"))
    if increments is None:
        return derived
    own = increments.select(*KEYS, "chapter_index", F.lit(1).alias("src"), F.posexplode("changes").alias("pos", "c"))
    return derived.unionByName(own.select(*KEYS, "chapter_index", "src", "pos", "c.field", "c.from", "c.to", "c.reason"))


def current(found: DataFrame) -> DataFrame:
    """The last value of each field, one column a field; missing ones are empty."""
    last = lambda f: F.coalesce(F.max_by("value", F.when(F.col("field") == f, F.col("chapter_index"))), F.lit("")).alias(f)
    return found.groupBy(*KEYS).agg(*(last(f) for f in rules.FIELDS))


def first_of_batches(rows: DataFrame, value: str = "value", batch: str = "batch") -> DataFrame:
    """Within a chapter the first batch with a value of a field wins."""
    return rows.where(T.strip(value) != "").groupBy(*KEYS, "chapter_index", "field").agg(F.min_by(value, batch).alias("value"))


def evolution(log: DataFrame) -> DataFrame:
    """``(field, text)``: the early and the late value of a field, or its only one."""
    ends = log.groupBy(*KEYS, "field").agg(F.min_by("value", "chapter_index").alias("first"), F.max_by("value", "chapter_index").alias("last"))
    text = F.when(F.col("first") == F.col("last"), F.col("last")).otherwise(F.concat(F.lit("早期："), "first", F.lit(" → 后期："), "last"))
    return ends.select(*KEYS, "field", text.alias("text"))


def running(found: DataFrame) -> DataFrame:
    """What was known of a field before each chapter that observes it."""
    return found.withColumn("known", F.last("value", ignorenulls=True).over(_field_order().rowsBetween(W.unboundedPreceding, -1)))


def relation_rows(relations: DataFrame) -> DataFrame:
    """``(target, description, evolution, n, first_seq)`` of ``(…, seq, target, change)``: all changes in order, the last
    one as the description; rows without target and change don't count."""
    kept = relations.where("coalesce(target, '') <> '' or coalesce(change, '') <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "change"))), lambda x: x["change"])
    return kept.groupBy(*KEYS, "target").agg(F.max_by("change", "seq").alias("description"), ordered.alias("evolution"), F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def summary(now: DataFrame | None, relations: DataFrame, changes: DataFrame | None = None, limit: int = 12, chars: int = 40, most_changes: int = 5) -> DataFrame:
    """``(book_id, character, summary, omitted)``: what is known of a character, short enough for every prompt.

    A line for each field that is filled, for each of the last ``limit`` relations, cut to ``chars``, for the number of
    older ones, and for the first ``most_changes`` changes ``(pos, field, from, to)``. Lines are rows with a place, put in
    order inside their character, of whom a few are left by then.
    """
    at = lambda group, place, text: F.struct(F.lit(group).alias("group"), place.cast("bigint").alias("place"), text.alias("text"))
    n, k = F.count("*").over(W.partitionBy(*KEYS)), F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("seq")))
    recent = relations.where("coalesce(target, '') <> '' or coalesce(change, '') <> ''").withColumn("n", n).withColumn("k", k).where(F.col("k") <= limit)
    short = T.preview(T.strip(F.coalesce("change", F.lit(""))), chars)
    older = F.greatest(F.lit(0), F.col("n") - limit)
    lines = recent.select(*KEYS, at(1, F.col("seq"), F.format_string(rules.SUMMARY_RELATION, F.coalesce("target", F.lit("")), short)).alias("line"), older.alias("older"))
    omitted = recent.where((F.col("k") == 1) & (F.col("n") > limit)).select(*KEYS, at(2, F.lit(0), F.format_string(rules.SUMMARY_OMITTED, older)).alias("line"), older.alias("older"))
    lines = lines.unionByName(omitted)
    none = F.lit(0).cast("bigint").alias("older")
    if now is not None:
        each = F.array(*(at(0, F.lit(k), F.when(F.coalesce(F.col(f), F.lit("")) != "", F.format_string(rules.SUMMARY_FIELD, F.lit(label), F.col(f)))) for k, (f, label) in enumerate(rules.FIELD_LABELS.items())))
        lines = lines.unionByName(now.select(*KEYS, F.explode(F.filter(each, lambda x: x["text"].isNotNull())).alias("line"), none))
    if changes is not None:
        first = changes.withColumn("k", F.row_number().over(W.partitionBy(*KEYS).orderBy("pos"))).where((F.col("k") <= most_changes) & (F.coalesce("field", F.lit("")) != ""))
        lines = lines.unionByName(first.select(*KEYS, at(3, F.col("k"), F.format_string(rules.SUMMARY_CHANGE, F.col("field"), F.col("from"), F.col("to"))).alias("line"), none))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n")
    return lines.groupBy(*KEYS).agg(text.alias("summary"), F.max("older").alias("omitted"))


def recent_summary(relations: DataFrame, limit: int = 12, chars: int = 40) -> DataFrame:
    """The relations' part of :func:`summary`."""
    return summary(None, relations, None, limit, chars)


def timeline_events(log: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` changes as events: number, id, summary, chapter label and the value before."""
    no = F.row_number().over(W.partitionBy(*KEYS).orderBy("chapter_index", "field_no")) - 1
    summary = F.when(F.col("previous").isNull(), F.concat("field", F.lit("："), "value")).otherwise(F.concat("field", F.lit("："), "previous", F.lit(" → "), "value"))
    numbered = log.withColumn("no", no).where(F.col("no") < limit)
    return numbered.select(
        *KEYS, F.col("no").alias("event_order"), F.concat(F.lit("t"), F.col("no").cast("string")).alias("id"), summary.alias("summary"),
        F.concat(F.lit("第"), F.col("chapter_index").cast("string"), F.lit("章")).alias("chapter"), F.col("previous").alias("quote"),
    )


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*key, "r.*")


def tagged_quotes(quotes: DataFrame) -> DataFrame:
    """Grounded quotes once per field and text, tagged with the chapter that had them first; chapter 0 has no tag."""
    base = quotes.withColumn("field", T.quote_field("field"))
    if "confidence" not in base.columns:
        base = base.withColumn("confidence", F.lit(""))
    once = first_seen(base.select(*KEYS, "field", "text", "chapter_index", "pos", "confidence"), [*KEYS, "field", "text"], ["chapter_index", "pos"])
    return once.withColumn("field", F.when(F.col("chapter_index") == 0, F.col("field")).otherwise(F.concat("field", F.lit("@ch"), F.col("chapter_index").cast("string"))))


def is_empty() -> Column:
    """Whether an increment has neither text nor relationships; quotes and samples don't count."""
    blank = F.lit(True)
    for f in rules.FIELDS:
        blank = blank & (F.coalesce(F.col(f), F.lit("")) == "")
    return blank & (F.size(F.coalesce("relationships", F.array().cast("array<struct<target:string,change:string>>"))) == 0)


def speech_head(samples: Column, most: int = 12) -> Column:
    return F.slice(F.array_distinct(samples), 1, most)


def samples(increments: DataFrame) -> DataFrame:
    """``(speech_samples)`` of each character: all distinct samples in the order of chapters."""
    each = increments.select(*KEYS, "chapter_index", F.posexplode("speech_samples").alias("pos", "sample"))
    once = first_seen(each, [*KEYS, "sample"], ["chapter_index", "pos"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "pos", "sample"))), lambda x: x["sample"])
    return once.groupBy(*KEYS).agg(ordered.alias("speech_samples"))

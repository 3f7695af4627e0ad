"""Bounded samples of labelled rows for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels that a sample can have; the most frequent ones count. With it a sample is bounded whatever the table holds.
MOST_LABELS = 32


def held_out():
    """True for the rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def piece_of(most_bytes: int):
    """A text, or of one with more bytes a run of about ``most_bytes`` from a place that its hash names."""
    n, size = F.char_length("text"), F.octet_length("text")
    chars = F.greatest(F.lit(1), F.floor(F.lit(most_bytes) * n / size).cast("int"))
    start = F.pmod(F.xxhash64("text"), (n - chars + 1).cast("bigint")).cast("int") + 1
    return F.when(size <= most_bytes, F.col("text")).otherwise(F.substring("text", start, chars))


def sample_texts(docs: DataFrame, labels: DataFrame, per_label: int, most_bytes: int) -> list[tuple[str, object]]:
    """Up to ``per_label`` pairs ``(text, label)`` for each of the ``MOST_LABELS`` most frequent labels of
    ``labels(doc_id, label)``.

    Ids come in the order of their hash, those of short texts first; of a longer text a piece of about ``most_bytes`` is
    taken, so that a corpus of long texts is learnt too. Held-out rows, null labels and null texts are left out. Of rows
    that repeat an id one is taken, whichever the order of the table. The sample has at most
    ``MOST_LABELS x per_label x most_bytes`` bytes.

    No label is gathered: a limit on the hash, from the label's count, leaves about twice ``per_label`` ids of each, and
    only those are ranked. Their table is small enough to broadcast at any size, so that no text is shuffled to meet it.
    """
    keys = labels.where(F.col("label").isNotNull() & ~held_out()).select("doc_id", "label").distinct()
    counts = [(r.label, r.n) for r in keys.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()]
    if not counts:
        return []
    place, limit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), F.lit(-1)
    for label, n in counts:
        limit = F.when(F.col("label") == F.lit(label), F.lit(((1 << 40) * (2 * per_label + 50)) // n)).otherwise(limit)
    chosen = keys.withColumn("place", place).where(F.col("place") < limit)
    rows = docs.where(F.col("text").isNotNull() & ~held_out()).select("doc_id", "text")
    met = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "place", (F.octet_length("text") > most_bytes).alias("long"), piece_of(most_bytes).alias("piece"))
    one = met.groupBy("doc_id", "label", "place").agg(F.min(F.struct("long", F.xxhash64("piece").alias("hash"), "piece")).alias("one"))
    again = W.partitionBy("label").orderBy("one.long", "place", "doc_id")
    kept = one.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= per_label)
    return [(r.piece, r.label) for r in kept.orderBy("label", "rank").select("one.piece", "label").collect()]

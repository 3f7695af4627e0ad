"""Bulk-synchronous best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoding import encoder
from .runtime import bounded_arrow, stored

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: only documents longer than ``capacity`` are cut."""
    bounded_arrow(docs.sparkSession)
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder("word", tokenizer)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(t or b"" for t in batch.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES.format(id=kind))


class _Runs:
    """Open sequences as runs of consecutive sequence numbers, by the gap that is left in them."""

    def __init__(self):
        self.by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.counts: dict[int, int] = defaultdict(int)

    def gaps(self, least: int) -> list[tuple[int, int]]:
        return [(g, n) for g, n in self.counts.items() if n and g >= least]

    def add(self, gap: int, first: int, count: int) -> None:
        self.by_gap[gap].append((first, count))
        self.counts[gap] += count

    def take(self, gap: int, count: int) -> list[tuple[int, int]]:
        out = []
        self.counts[gap] -= count
        while count:
            first, n = self.by_gap[gap].pop()
            used = min(n, count)
            out.append((first, used))
            if n > used:
                self.by_gap[gap].append((first + used, n - used))
            count -= used
        return out


def successor_sweep(lengths: dict[int, int], gaps: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """One superstep's matches ``(length, gap, count)`` between the sorted lists of documents and of gaps.

    Each document asks for the smallest gap that holds it. Documents that ask for one gap are in conflict: the longest
    one has it, and the others move on to the next gap that is still free. A sweep from the longest document down, with
    free gaps kept on a stack whose top is the smallest gap that is large enough, gives just that. A gap takes one
    document a superstep.
    """
    matches, stack = [], []
    free = sorted(gaps, reverse=True)
    at = 0
    for length in sorted(lengths, reverse=True):
        while at < len(free) and free[at][0] >= length:
            stack.append(list(free[at]))
            at += 1
        left = lengths[length]
        while left and stack:
            n = min(left, stack[-1][1])
            matches.append((length, stack[-1][0], n))
            left -= n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
    return matches


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements ``(length, rank_from, count, first_sequence, offset)`` and the number of sequences.

    Lengths are integers up to ``capacity``, so the range-sorted lists of documents and of gaps are kept run-length
    encoded: at most ``capacity`` entries each, at any corpus size. A superstep sweeps both lists, updates the gaps,
    then repeats for what is left. Where documents remain without a gap, the longest ones open new sequences: all above
    half the capacity, which can never share one, or else as many as those of the greatest length left fill.
    """
    left = {k: n for k, n in sorted(histogram.items()) if n}
    used: dict[int, int] = defaultdict(int)
    runs, placed, n_sequences = _Runs(), [], 0

    def place(length: int, spans: list[tuple[int, int]], gap: int) -> None:
        for first, n in spans:
            placed.append((length, used[length], n, first, capacity - gap))
            used[length] += n
            left[length] -= n
            if gap > length:
                runs.add(gap - length, first, n)
        if not left[length]:
            del left[length]

    while left:
        # Only the longest half of the range takes part until it is placed: short documents fill what others leave.
        top = max(left)
        band = {k: n for k, n in left.items() if 2 * k > top or k == top}
        matches = successor_sweep(band, runs.gaps(min(band)))
        taken = [(length, gap, runs.take(gap, n)) for length, gap, n in matches]
        for length, gap, spans in taken:
            place(length, spans, gap)
        if matches:
            continue
        long = [k for k in left if 2 * k > capacity]
        if long:
            for length in sorted(long, reverse=True):
                n = left[length]
                place(length, [(n_sequences, n)], capacity)
                n_sequences += n
            continue
        share = capacity // top
        n = -(-left[top] // share)
        place(top, [(n_sequences, n)], capacity)
        n_sequences += n
    return placed, n_sequences


def length_ranks(pieces: DataFrame) -> DataFrame:
    """Add ``rank``: the place of a piece among those of its length, from 0, in the range-sorted order.

    Range partitions by (length, doc_id, piece) split any frequent length; ranks within a partition plus the counts of
    the partitions before give the rank, so that no length is gathered in one task.
    """
    spark = pieces.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["length", "doc_id", "piece", "start"]
    sorted_ = stored(pieces.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "pack-sorted")
    counts = sorted_.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "part").orderBy("doc_id", "piece", "start")
    return sorted_.withColumn("r", F.row_number().over(within) - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("r")).drop("r", "base", "part")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece.

    The plan holds one entry for each run of equal placements. It is joined to the ranked pieces by length and by the
    largest ``rank_from`` that isn't above a piece's rank: plan entries and pieces are merged in one sorted window.
    Equal lengths are interchangeable, so ties are settled by document id. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces, "pack-pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # capacity rows at most
    placed, _ = plan_packing(histogram, capacity)
    entries: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for length, rank, n, first, offset in placed:
        entries[length].append((rank, n, first, offset))
    plan = spark.createDataFrame(
        [(k, rank, n, first, offset) for k, v in entries.items() for rank, n, first, offset in v] or [],
        "length bigint, rank_from bigint, n bigint, first bigint, offset bigint",
    )
    return assign(length_ranks(pieces), plan)


def assign(ranked: DataFrame, plan: DataFrame, block: int = 1024) -> DataFrame:
    """Join ranks to the plan's spans: both sides are cut into blocks of ranks, so the join is an equi-join."""
    spans = plan.withColumn("block", F.explode(F.sequence(F.expr(f"rank_from div {block}"), F.expr(f"(rank_from + n - 1) div {block}"))))
    left = ranked.withColumn("block", F.expr(f"rank div {block}"))
    return (
        left.join(spans, ["length", "block"])
        .where("rank >= rank_from and rank < rank_from + n")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("first + rank - rank_from").alias("sequence_id"), "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone; a longer document than a sequence is cut, whatever its length. Repeated rows
    are packed each; pieces of one length are interchangeable, so ties go by document id, piece and start. An empty table
    gives no rows; extra columns are ignored.
    """
    return pack(cut_pieces(docs, tokenizer, end_id, capacity), capacity)

"""Minimax contiguous sharding of atomic groups, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch

FAN = 256
#: Bins of the first look at the running sums: a bound on what the driver holds, whatever the number of groups.
FIRST_BINS = 1 << 14


class RunningSums:
    """Group ends, as running sums of bytes, seen through bins that are refined where an exact answer needs it.

    The driver holds the least and the greatest group end of some bins: ``FIRST_BINS`` at first, then ``FAN`` more for
    each bin that a lookup couldn't settle. It never holds the groups.
    """

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.width = 1 << max(0, (total // FIRST_BINS).bit_length())  # powers of two, so that bins nest
        self.bins: dict[tuple[int, int], tuple[int, int]] = {}
        self.refined: set[tuple[int, int]] = set()
        self.unsure: set[tuple[int, int]] = set()
        rows = ends.groupBy(F.expr(f"end div {self.width}").alias("k")).agg(F.min("end").alias("lo"), F.max("end").alias("hi")).collect()
        for r in rows:
            self.bins[(self.width, r.k)] = (r.lo, r.hi)
        self.top = sorted(r.k for r in rows)

    def _child(self, width: int) -> int:
        return max(1, width // FAN)

    def floor(self, target: int) -> int:
        """The greatest group end up to ``target``, or 0. Where bins leave it open, a bound, and the bin is noted."""
        from bisect import bisect_right

        if target <= 0:
            return 0
        width, k, below = self.width, target // self.width, 0
        at = bisect_right(self.top, k)
        while True:
            own = self.bins.get((width, k))
            if width == self.width:
                before = at - 1 - (at > 0 and self.top[at - 1] == k)
                below = self.bins[(width, self.top[before])][1] if before >= 0 else 0
            else:
                inside = (self.bins.get((width, j)) for j in range(parent * parent_width // width, k))
                below = max([below, *(x[1] for x in inside if x)])
            if own is None or own[0] > target:
                return below
            if own[1] <= target:
                return own[1]
            if (width, k) not in self.refined:
                self.unsure.add((width, k))
                return own[0]
            parent, parent_width, width = k, width, self._child(width)
            k = target // width

    def refine(self) -> bool:
        """Look into the bins that were noted; False if there are none."""
        if not self.unsure:
            return False
        for width in {w for w, _ in self.unsure}:
            keys, child = sorted(k for w, k in self.unsure if w == width), self._child(width)
            rows = (
                self.ends.where(F.expr(f"end div {width}").isin(keys))
                .groupBy(F.expr(f"end div {child}").alias("k"))
                .agg(F.min("end").alias("lo"), F.max("end").alias("hi"))
                .collect()
            )
            for r in rows:
                self.bins[(child, r.k)] = (r.lo, r.hi)
            self.refined |= {(width, k) for k in keys}
        self.unsure = set()
        return True


def greedy_cuts(sums: RunningSums, capacity: int, shards: int) -> list[int] | None:
    """Cuts when each shard takes groups while they fit; None if the last shard doesn't reach the end."""
    cuts, at = [], 0
    for _ in range(shards):
        at = sums.floor(at + capacity)
        cuts.append(at)
    return cuts if at >= sums.total else None


def minimax_cuts(sums: RunningSums, shards: int, largest: int) -> list[int]:
    """The shards' ends for the smallest feasible capacity.

    Capacity is found by binary search with the greedy check. The cuts are those of the greedy check, moved towards
    equal shares as far as that capacity allows: never behind the greedy cut of the capacity, never so early that the
    shards after it couldn't hold the rest.
    """
    while True:
        low, high = max(largest, -(-sums.total // shards)), max(largest, -(-sums.total // shards) + largest)
        while low < high:
            middle = (low + high) // 2
            if greedy_cuts(sums, middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        cuts, at = [], 0
        for k in range(1, shards):
            most = sums.floor(at + low)
            at = min(most, max(at, sums.floor(round(sums.total * k / shards) + largest // 2)))
            # what is left must fit: else the greedy cut
            rest, reach = shards - k, at
            for _ in range(rest):
                reach = sums.floor(reach + low)
            if reach < sums.total:
                at = most
            cuts.append(at)
        cuts.append(sums.total)
        if not sums.refine():
            return cuts


def shard(docs: DataFrame, shards: int = 24, row_bytes: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one per input row; the law is ``bytes``.

    Equal texts are one group and stay together; null texts count as empty and share the group of the empty text. Groups are
    ordered by a digest of the text, which is a fixed shuffle. A group of at least a fair share of the bytes gets a
    shard of its own (there are fewer than ``shards`` of them); the others are cut contiguously into the shards left,
    minimising the largest. Fewer groups than shards leave shards empty. An empty table gives no rows.

    No group is gathered: rows are range-partitioned by (digest, doc_id), which splits a hot group, and running sums
    are those within a partition plus the sums of the partitions before.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(
            "doc_id",
            (F.octet_length(text) + row_bytes).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        )
        rows = scratch.store(rows, "shard-rows")
        groups = scratch.store(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        giants, left, free = [], total, shards
        # at most ``shards`` groups can reach a fair share: the heads of the list are enough
        for g in groups.orderBy(F.desc("bytes"), "digest").limit(shards - 1).collect():
            if g.bytes * free < left:
                break
            giants.append(g)
            left, free = left - g.bytes, free - 1
        own = F.lit(None).cast("int")
        for k, g in enumerate(giants):
            own = F.when(F.col("digest") == F.lit(bytearray(g.digest)), k).otherwise(own)
        before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)

        ordered = scratch.store(rows.withColumn("own", own).repartitionByRange(n, F.coalesce("own", F.lit(-1)), "digest", "doc_id").withColumn("part", F.spark_partition_id()), "shard-ordered")
        share = F.when(F.col("own").isNull(), F.col("size")).otherwise(0)
        sums = ordered.groupBy("part").agg(F.sum(share).alias("b"), F.count("*").alias("c"))
        bases = sums.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("row_base"))
        order = W.partitionBy("part").orderBy(F.coalesce("own", F.lit(-1)), "digest", "doc_id")
        running = (
            ordered.withColumn("bytes_in", F.sum(share).over(order.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("row_in", F.row_number().over(order))
            .join(bases, "part")
            .select("doc_id", "size", "text_crc32", "digest", "own", (F.col("byte_base") + F.col("bytes_in")).alias("prefix"), (F.col("row_base") + F.col("row_in")).alias("row"))
        )
        running = scratch.store(running, "shard-running")
        ends = scratch.store(running.where("own is null").groupBy("digest").agg(F.max("prefix").alias("end"), F.sum("size").alias("bytes")), "shard-ends")
        if left:
            largest = ends.agg(F.max("bytes")).first()[0]
            cuts = minimax_cuts(RunningSums(ends.select("end"), left), free, largest)
        else:
            cuts = []
        # a row is in the first shard whose end isn't below the row's own running sum
        base = len(giants)
        number = F.lit(base + max(0, len(cuts) - 1))
        for k in range(len(cuts) - 2, -1, -1):
            number = F.when(F.col("prefix") <= cuts[k], base + k).otherwise(number)
        placed = running.withColumn("shard", F.coalesce("own", number).cast("int"))
        firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
        found = placed.join(F.broadcast(firsts), "shard").select(  # one row a shard
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
        )
        return scratch.result(found, "shards")

"""Word shingles of texts, and the exact similarity of their sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch, bounded_arrow, narrow_join

SEED = 42


def shingle_hashes(data: bytes, width: int):
    """XXH64 of each run of ``width`` words of a text, or of all its words if it has fewer.

    Words are lower-cased in A-Z only and are runs of other bytes than 20 and 09 to 0D.
    """
    import numpy as np
    import xxhash

    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    last = ends[min(width, len(words)) - 1 :].tolist()
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts, last)), dtype=np.uint64, count=len(last))


def majority_bits(hashes) -> list[int]:
    """Of each row of a table of hashes, the 64 bits that are set in over half of them; none of no hashes."""
    import numpy as np

    n, (m, size) = hashes.shape[1], (hashes.shape[0], -(-hashes.shape[1] // 255))
    lanes = np.zeros((m, size * 255), dtype=np.uint64)  # 255 hashes fill a counter of 8 bits at most
    lanes[:, :n] = hashes
    lanes = lanes.reshape(m, size, 255)
    found = [0] * m
    for k in range(8):
        sums = ((lanes >> np.uint64(k)) & np.uint64(0x0101010101010101)).sum(axis=2, dtype=np.uint64)
        counts = sums.view(np.uint8).reshape(m, size, 8).sum(axis=1, dtype=np.int64)
        for row, byte in zip(*(x.tolist() for x in np.nonzero(2 * counts > n))):
            found[row] |= 1 << (8 * byte + k)
    return found


#: Odd factors that make three more sets of hashes of one, for the bits beyond the first 64 of a wide fingerprint.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Bits of 256 in which wide fingerprints of sets with a similarity of 0.8 may differ: 38.8 do on average, and over 60 in
#: one case of ten thousand; of sets without anything in common 128 do, and hardly ever less than 90.
WIDE = 60


def wide_bits(hashes) -> list[int]:
    """Four fingerprints of a set: of its hashes, and of three mixtures of them."""
    import numpy as np

    rows = [hashes]
    for f in FACTORS:
        x = hashes * np.uint64(f)
        x ^= x >> np.uint64(29)
        x *= np.uint64(FACTORS[0])
        rows.append(x ^ (x >> np.uint64(32)))
    return majority_bits(np.stack(rows))


def copies_key(text: str) -> Column:
    """A digest of a text in 16 bytes; a null text has that of the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, text_digest, digest, fp, w1, w2, w3)``: the digest of a text, that of its set of shingles, and the set's
    wide fingerprint, of which ``fp`` is the first part."""
    bounded_arrow(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            digests, prints = [], []
            for text in batch.column(2).to_pylist():
                found = np.unique(shingle_hashes(text or b"", width))
                digests.append(xxhash.xxh128_digest(found.tobytes()))
                prints.append(wide_bits(found))
            bits = np.array(prints, dtype=np.uint64).reshape(-1, 4).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_digest", "digest", "fp", "w1", "w2", "w3"])

    rows = docs.select("doc_id", copies_key("text").alias("text_digest"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_digest binary, digest binary, fp bigint, w1 bigint, w2 bigint, w3 bigint")


#: Sets of a block: two blocks' sets and the pairs between them meet in one place. Pairs a node from which that saves.
BLOCK, DENSE = 128, 4


def blocked(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b, u, v)``: each pair with the place where its sets meet, two blocks of a bounded number of sets.

    Few pairs for their nodes meet by one node and a run of others. Where there are many, nodes with the same smallest
    neighbour, which large groups have, are cut into blocks, and the pairs of two blocks meet in one place: so a set goes
    once to each pair of blocks that needs it, not to each of its pairs.
    """
    place = lambda label, block: F.struct(label.cast("bigint").alias("label"), block.cast("bigint").alias("block"))
    both = pairs.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("near")))
    labels = both.groupBy("node").agg(F.least("node", F.min("near")).alias("label"))
    if pairs.count() <= DENSE * labels.count():
        return pairs.select(place(F.col("u"), F.lit(0)).alias("a"), place(F.lit(0), F.floor(F.col("v") / BLOCK)).alias("b"), "u", "v")
    number = F.row_number().over(W.partitionBy("label").orderBy("node")) - 1
    placed = scratch.store(labels.select("node", place(F.col("label"), F.floor(number / BLOCK)).alias("place")), "copies-blocks")
    for c in "uv":
        pairs = pairs.join(placed.select(F.col("node").alias(c), F.col("place").alias(f"{c}_place")), c)
    return scratch.store(pairs.select(F.least("u_place", "v_place").alias("a"), F.greatest("u_place", "v_place").alias("b"), "u", "v"), "copies-keyed")


def member_sets(named: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """``(node, members)``: the sets of the ``nodes(node, doc_id, text_digest)`` that ``named(node)`` names, as the bytes of
    sorted hashes. Each is made once, of one document's text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = [np.unique(shingle_hashes(t or b"", width)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "members"])

    asked = nodes.join(named.distinct(), "node").select("node", F.col("doc_id").alias("asked_id"), F.col("text_digest").alias("asked_text"))
    asked = scratch.store(asked, "copies-asked")  # names of near copies alone: other texts aren't shuffled to meet them
    rows = docs.select("doc_id", copies_key("text").alias("text_digest"), F.col("text").cast("binary").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("text_digest") == F.col("asked_text"))
    some = narrow_join(rows, asked, same, "inner", F.xxhash64("text_digest"), F.xxhash64("asked_text")).select("node", "text")
    return scratch.store(some.mapInArrow(sets, "node bigint, members binary").dropDuplicates(["node"]), "copies-sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Those of ``pairs(u, v)`` whose ``sets`` have a Jaccard similarity of ``num / den`` or more."""

    def compare(group: pa.Table) -> pa.Table:
        import numpy as np

        kind = np.asarray(group["members"].is_null())
        own, rows = group.filter(pa.array(~kind)), group.filter(pa.array(kind))
        held = {n: np.frombuffer(m.as_buffer(), np.uint64) for n, m in zip(own["u"].to_pylist(), own["members"])}
        keep = []
        for u, v in zip(rows["u"].to_pylist(), rows["v"].to_pylist()):
            x, y = held[u], held[v]
            most = min(len(x), len(y))  # what they can share
            if den * most < num * (len(x) + len(y) - most):
                keep.append(False)
                continue
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(den * shared >= num * (len(x) + len(y) - shared))
        return rows.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    keyed = blocked(pairs, scratch)
    needed = keyed.select("a", "b", F.explode(F.array("u", "v")).alias("node")).distinct()
    shipped = needed.join(sets, "node").select("a", "b", F.col("node").alias("u"), F.lit(None).cast("bigint").alias("v"), "members")
    whole = shipped.unionByName(keyed.withColumn("members", F.lit(None).cast("binary")).select("a", "b", "u", "v", "members"))
    return whole.groupBy("a", "b").applyInArrow(compare, "u bigint, v bigint")


#: Bytes of the sets of a block of a crowd, and its number of blocks by the root of its size: so many sets go to so many
#: places that rows grow with the power 1.5 of a crowd's size.
BLOCK_BYTES, ROOT = 8 << 20, 2.5


def crowd_places(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """``crowds(node, crowd, ...)`` with ``members`` and the places ``a, b`` where their blocks meet, each block with itself
    and with each other one. A crowd of ``BLOCK`` sets at most, as nearly all are, is one block."""
    rows = crowds.join(sets, "node")
    size = crowds.select("node", "crowd").join(sets.select("node", F.octet_length("members").alias("bytes")), "node").groupBy("crowd").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.when(F.col("rows") > BLOCK, F.ceil(F.sqrt("rows") / ROOT)).otherwise(F.lit(1)), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("bigint")
    large = size.select("crowd", blocks.alias("blocks")).where("blocks > 1")
    rows = rows.join(F.broadcast(large), "crowd", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.select(*crowds.columns, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "members")


def crowd_links(num: int, den: int, reach: int):
    """The function of one place: edges that join the groups of its sets by all links there are between them.

    Links are pairs of different roots whose fingerprints are near and whose sets have a similarity of ``num / den`` or
    more. Two sets share at most what either has in common with any other set of the place, so those with much of their
    own are compared no further. Of the others, the members of the pairs that are still open are counted.
    """

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        node, root, block = (np.asarray(group[c]) for c in ("node", "root", "block"))
        wide = [np.asarray(group[c]).view(np.uint64) for c in ("fp", "w1", "w2", "w3")]
        held = [np.frombuffer(m.as_buffer(), np.uint64) for m in group["members"]]
        size = np.array([len(x) for x in held], dtype=np.int64)
        start = np.cumsum(size) - size
        values, token = np.unique(np.concatenate(held), return_inverse=True)
        several = np.r_[0, np.cumsum(np.bincount(token, minlength=len(values))[token] > 1)]
        common = several[start + size] - several[start]
        _, at, group_of = np.unique(root, return_index=True, return_inverse=True)
        labels, has = np.arange(len(at)), np.zeros(len(values), dtype=bool)
        within = group["a"][0] == group["b"][0]
        first = np.arange(len(node)) if within else np.flatnonzero(block == group["a"][0].as_py())
        second = first if within else np.flatnonzero(block == group["b"][0].as_py())
        us, vs = [], []
        for k, i in enumerate(first.tolist()):
            j = second[k + 1 :] if within else second
            most = np.minimum(common[i], common[j])
            j = j[(labels[group_of[i]] != labels[group_of[j]]) & ((num + den) * most >= num * (size[i] + size[j])) & (most > 0)]
            j = j[np.bitwise_count(wide[0][i] ^ wide[0][j]) <= reach]
            j = j[sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in wide) <= WIDE]
            if not len(j):
                continue
            ends = np.cumsum(size[j])
            own = token[start[i] : start[i] + size[i]]
            has[own] = True
            shared = np.add.reduceat(has[token[np.arange(ends[-1]) + np.repeat(start[j] - ends + size[j], size[j])]].astype(np.int64), ends - size[j])
            has[own] = False
            j = j[(num + den) * shared >= num * (size[i] + size[j])]
            while len(j):  # one edge for each group that this set joins
                us.append(int(node[i])), vs.append(int(node[j[0]]))
                labels[labels == labels[group_of[j[0]]]] = labels[group_of[i]]
                j = j[labels[group_of[j]] != labels[group_of[i]]]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run

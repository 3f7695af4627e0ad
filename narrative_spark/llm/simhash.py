"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import Scratch, bounded_arrow, free_names, narrow_join, stored, tidy
from .shingles import WIDE, copies_key, crowd_links, crowd_places, majority_bits, member_sets, shingle_hashes, shingled, similar_pairs

#: Fingerprints of a page, of a leaf of its tree, children of a node above, and pairs of nodes looked at together.
PAGE = 4096
LEAF = 16
FAN = 8
FRONTIER = 1 << 14
#: Rows of one fingerprint from which its rows are joined apart: more than one in so many of all, so these are few.
HOT = 1000


def document_fingerprint(data: bytes, width: int) -> int:
    return majority_bits(shingle_hashes(data, width)[None, :])[0]


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` with the 64 bits as a signed long. Null and blank texts have fingerprint zero."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = np.array([document_fingerprint(t or b"", width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


class GrayIndex:
    """A tree over Gray-sorted fingerprints. A node keeps the bits that all below it share, as a mask and a pattern."""

    def __init__(self, values):
        import numpy as np

        self.values = values
        both, either, step = values, values, LEAF
        self.levels = []
        while True:
            at = np.arange(0, len(both), step)
            both, either = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)
            self.levels.append((both, ~(both ^ either)))
            if len(at) <= FAN:
                break
            step = FAN

    @property
    def root(self):
        pattern, mask = self.levels[-1]
        return pattern, mask


def tree_pairs(a: GrayIndex, b: GrayIndex, distance: int) -> Iterator[tuple]:
    """Index arrays ``(i, j)`` of linked values of ``a`` and ``b`` (of ``i < j`` where both are one index).

    Pairs of nodes go down both trees together. The bits in which the shared patterns of two nodes differ are
    differences of all pairs below, so whole groups go once they exceed ``distance``. The frontier is bounded.
    """
    import numpy as np

    same, top = a is b, max(len(a.levels), len(b.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(level(a, top)[0])), np.arange(len(level(b, top)[0])), indexing="ij"))
    stack = [(top, i, j)]
    inner = np.arange(LEAF)
    while stack:
        k, i, j = stack.pop()
        if len(i) > FRONTIER:
            half = len(i) // 2
            stack += [(k, i[:half], j[:half]), (k, i[half:], j[half:])]
            continue
        if same:
            keep = i <= j
            i, j = i[keep], j[keep]
        (pa_, ma), (pb, mb) = level(a, k), level(b, k)
        keep = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= distance
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if k:
            fa, fb = (FAN if k < len(t.levels) else 1 for t in (a, b))
            ci = (i[:, None, None] * fa + np.arange(fa)[None, :, None]).repeat(fb, axis=2).ravel()
            cj = (j[:, None, None] * fb + np.arange(fb)[None, None, :]).repeat(fa, axis=1).ravel()
            keep = (ci < len(level(a, k - 1)[0])) & (cj < len(level(b, k - 1)[0]))
            stack.append((k - 1, ci[keep], cj[keep]))
            continue
        for at in range(0, len(i), 512):
            x, y = i[at : at + 512, None] * LEAF + inner, j[at : at + 512, None] * LEAF + inner
            inside_x, inside_y = x < len(a.values), y < len(b.values)
            vx, vy = a.values[np.where(inside_x, x, 0)], b.values[np.where(inside_y, y, 0)]
            near = np.bitwise_count(vx[:, :, None] ^ vy[:, None, :]) <= distance
            near &= inside_x[:, :, None] & inside_y[:, None, :]
            if same:
                near &= x[:, :, None] < y[:, None, :]
            r, p, q = np.nonzero(near)
            if len(r):
                yield x[r, p], y[r, q]


def merged(labels, i, j):
    """``labels`` after joining the components of the pairs; a label is the smallest index of its component."""
    import numpy as np

    while True:
        a, b = labels[i], labels[j]
        keep = a != b
        if not keep.any():
            return labels
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        labels = parent[labels]


#: Edges of a table, 4 MB, that one task joins.
FEW = 1 << 18


def linked(edges: DataFrame) -> DataFrame:
    """``(node, root)`` as :func:`components`, which takes larger tables. Few edges are joined in one task: for them, the
    rounds would cost the driver more in plans than they spread in work. The table is read twice."""
    if edges.count() > FEW:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        found = [np.stack([np.asarray(b.column(k)) for k in (0, 1)]) for b in batches]
        u, v = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        labels = merged(np.arange(len(ids)), at[: len(u)], at[len(u) :])
        own = np.flatnonzero(labels != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[labels[own]])], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node bigint, root bigint")


def _small_labels(values, distance: int):
    import numpy as np

    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    i, j = np.nonzero(np.triu(near, 1))
    return merged(np.arange(len(values)), i, j)


def page_labels(values, distance: int):
    import numpy as np

    if len(values) <= 2 * LEAF:
        return _small_labels(values, distance)
    labels, index = np.arange(len(values)), GrayIndex(values)
    for i, j in tree_pairs(index, index, distance):
        labels = merged(labels, i, j)
    return labels


LINKS = "page boolean, rotation int, bucket int, number bigint, pattern bigint, mask bigint, members binary, labels binary, u bigint, v bigint"


def _edges(values, labels):
    import numpy as np

    own = np.flatnonzero(labels != np.arange(len(labels)))
    return values[labels[own]], values[own]


def _link_batch(u, v) -> pa.RecordBatch:
    import numpy as np

    n = len(u)
    kinds = {"rotation": pa.int32(), "bucket": pa.int32(), "number": pa.int64(), "pattern": pa.int64(), "mask": pa.int64(), "members": pa.binary(), "labels": pa.binary()}
    columns = [pa.array(np.zeros(n, bool)), *(pa.nulls(n, k) for k in kinds.values()), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["page", *kinds, "u", "v"])


def _page_batch(pages: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    rows = [(True, *p, None, None) for p in pages]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in LINKS.split(", ")])


def bucket_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pages ``(order, bucket, arrays, give, partition)`` of one range partition sorted by order and Gray rank.

    Batches have the columns order, bucket, any number of longs, and the partition's number. A page holds up to ``PAGE``
    consecutive rows of one bucket. ``give`` says that the bucket has other pages, here or beyond an end of the
    partition. What may go on in the next batch is held back, less than two pages.
    """
    import numpy as np

    pid, held, first, open_bucket = None, None, True, None

    def process(columns, final):
        nonlocal first, open_bucket
        rot, key = columns[0], columns[1]
        code = rot.astype(np.int64) << 32 | key.astype(np.int64)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[starts[1:], len(code)]
        hold, pages = len(code), []
        for s, e in zip(starts.tolist(), ends.tolist()):
            last = e == len(code)
            if last and not final and e - s < PAGE:
                hold = s
                break
            give = first or last or e - s > PAGE or open_bucket == code[s]
            for at in range(s, e, PAGE):
                if last and not final and at + PAGE > e:
                    hold = at
                    break
                pages.append((int(rot[s]), int(key[s]), [c[at : min(at + PAGE, e)] for c in columns[2:]], give, pid))
            open_bucket = code[s]
            first = False
        return pages, [c[hold:] for c in columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        pid = batch.column(batch.num_columns - 1)[0].as_py() if pid is None else pid
        columns = [np.asarray(batch.column(k)) for k in range(batch.num_columns - 1)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        pages, held = process(columns, False)
        yield from pages
    if held is not None and len(held[0]):
        yield from process(held, True)[0]


def _signed(x) -> int:
    import numpy as np

    return int(np.uint64(x).view(np.int64))


def shared_bits(values) -> tuple[int, int]:
    """The bits that all values share, as a pattern and a mask."""
    import numpy as np

    both, either = np.bitwise_and.reduce(values), np.bitwise_or.reduce(values)
    return _signed(both), _signed(~(both ^ either))


def index_pages(distance: int):
    """The function of one range partition: edges within pages, and pages.

    A bucket that lies in one page inside the partition is finished here. Pages of larger buckets, and those at an end
    of the partition, are given out to be compared with their bucket's other pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number, us, vs, n_edges, pages = 0, [], [], 0, []
        for rotation, bucket, (values,), give, pid in bucket_pages(batches):
            values = values.view(np.uint64)
            labels = page_labels(values, distance)
            u, v = _edges(values, labels)
            us.append(u), vs.append(v)
            n_edges += len(u)
            if give:
                number += 1
                pages.append((rotation, bucket, (pid << 32) + number, *shared_bits(values), values.tobytes(), labels.astype("<i4").tobytes()))
            if len(pages) == 64:
                yield _page_batch(pages)
                pages = []
            if n_edges > 50_000:
                yield _link_batch(np.concatenate(us), np.concatenate(vs))
                us, vs, n_edges = [], [], 0
        if pages:
            yield _page_batch(pages)
        if n_edges:
            yield _link_batch(np.concatenate(us), np.concatenate(vs))

    return run


def cross_pages(distance: int):
    """Edges between the components of two pages of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            us, vs = [], []
            for ma, la, mb, lb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a, b = np.frombuffer(ma, np.uint64), np.frombuffer(mb, np.uint64)
                labels = np.concatenate([np.frombuffer(la, "<i4").astype(np.int64), np.frombuffer(lb, "<i4").astype(np.int64) + len(a)])
                before, values = labels, np.concatenate([a, b])
                for i, j in tree_pairs(GrayIndex(a), GrayIndex(b), distance):
                    labels = merged(labels, i, j + len(a))
                roots = np.unique(before)
                moved = roots[labels[roots] != roots]
                us.append(values[labels[moved]]), vs.append(values[moved])
            u, v = (np.concatenate([*x, np.zeros(0, np.uint64)]).view(np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def page_pairs(pages: DataFrame, distance: int, apart: Column | None = None) -> DataFrame:
    """Pairs of pages of one bucket, numbers only, whose shared patterns differ in ``distance`` bits at most."""
    small = pages.select("rotation", "bucket", "number", "pattern", "mask", *(["root"] if "root" in pages.columns else []))
    a, b = (small.select("rotation", "bucket", *(F.col(c).alias(f"{c}_{x}") for c in small.columns[2:])) for x in "ab")
    bits = F.bit_count(F.col("pattern_a").bitwiseXOR(F.col("pattern_b")).bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b")))
    met = a.join(b, ["rotation", "bucket"]).where((F.col("number_a") < F.col("number_b")) & (bits <= distance))
    return (met if apart is None else met.where(apart)).select("number_a", "number_b")


def with_pages(pairs: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """The pages of each pair that is left, fetched by number."""
    for x in "ab":
        pairs = pairs.join(pages.select(F.col("number").alias(f"number_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns)), f"number_{x}")
    return pairs.select(*(f"{c}_{x}" for x in "ab" for c in columns))


def block_orders(n: int, distance: int, blocks: int | None = None) -> list[tuple[list[int], int]]:
    """Orders for ``n`` fingerprints: the 64 bits from the top on, and how many of them make a bucket.

    Fingerprints that differ in at most ``distance`` of ``m`` blocks agree in ``m - distance`` of them, so any choice of
    so many blocks leads one order. One block more than ``distance`` makes few orders of short buckets; each block more
    makes more orders of longer ones. The fewest blocks are taken whose buckets have two pages of fingerprints on average.
    """
    from itertools import combinations

    def made(m: int):
        bounds = [64 * k // m for k in range(m + 1)]
        parts = [list(range(b - 1, a - 1, -1)) for a, b in zip(bounds, bounds[1:])]
        for chosen in combinations(range(m), m - distance):
            yield [x for k in (*chosen, *(k for k in range(m) if k not in chosen)) for x in parts[k]], sum(len(parts[k]) for k in chosen)

    m = blocks or distance + 1
    while not blocks and m < distance + 4 and n >> min(bits for _, bits in made(m)) > 2 * PAGE:
        m += 1
    return list(made(m))


def turned_rows(orders: list[tuple[list[int], int]]):
    """Rows ``(rotation, bucket, rank, ...)`` of every order for rows that begin with a fingerprint: the bits in that
    order, their leading ones as the bucket, and their place in the reflected Gray sequence as a signed rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            fp = np.ascontiguousarray(np.asarray(batch.column(0)).view(np.uint64))
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1)
            for r, (order, key) in enumerate(orders):
                columns = [8 * (b // 8) + 7 - b % 8 for b in order]  # bytes come lowest first, bits in them highest first
                x = np.packbits(bits[:, columns], axis=1).reshape(-1).view(">u8").astype(np.uint64)
                rank = x.copy()
                for shift in (1, 2, 4, 8, 16, 32):  # the running exclusive-or of the bits from the top
                    rank ^= rank >> np.uint64(shift)
                rank ^= np.uint64(1 << 63)  # for a signed sort
                found = [np.full(len(fp), r, np.int32), (x >> np.uint64(64 - key)).astype(np.int32), rank.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), *batch.columns], names=["rotation", "bucket", "rank", *batch.schema.names])

    return run


def ranked(rows: DataFrame, orders: list[tuple[list[int], int]]) -> DataFrame:
    """``rows`` of longs, the first a fingerprint, in every order: range-partitioned by order and Gray rank, sorted, with
    the partition's number."""
    kinds = ", ".join(f"{c} bigint" for c in rows.columns)
    turned = rows.mapInArrow(turned_rows(orders), f"rotation int, bucket int, rank bigint, {kinds}")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = turned.repartitionByRange(n, "rotation", "rank").sortWithinPartitions("rotation", "rank")
    return ordered.select("rotation", "bucket", *rows.columns, F.spark_partition_id().alias("pid"))


def near_links(distinct: DataFrame, distance: int, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct fingerprints (column ``fp``) within ``distance`` bits.

    The 64 bits are cut into blocks. Turning some of them to the top and sorting by Gray rank puts fingerprints that
    agree in them next to each other: every linked pair meets in one of these orders. Range partitions of the orders are
    indexed apart, and pairs of pages of a bucket that lies in several are pruned by their shared patterns before the
    pages themselves are fetched. Of each page's links, a spanning forest goes out, never all pairs.
    """
    orders = block_orders(distinct.count(), distance, blocks)
    found = scratch.store(ranked(distinct.select("fp"), orders).mapInArrow(index_pages(distance), LINKS), "simhash-index")
    pages = found.where("page")
    crossed = with_pages(scratch.store(page_pairs(pages, distance), "simhash-pairs"), pages, "members", "labels").mapInArrow(cross_pages(distance), "u bigint, v bigint")
    return found.where("not page").select("u", "v").unionByName(crossed)


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """Join ``rows`` to ``table(key, rows, ...)``, which has one row a key and counts the rows of it, of ``n`` in all.

    Keys of at least one in ``HOT`` of all rows are fewer than ``HOT``: they are broadcast, and their rows stay where
    they are. The others meet in a shuffle.
    """
    hot = table.where(F.col("rows") * HOT >= n)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col("rows") * HOT < n), key)
    return near.unionByName(far)


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Equal fingerprints are one node, so that copies cost one row whatever their number. ``component_id`` is the
    smallest ``doc_id`` that links reach. Null and blank texts have fingerprint zero and link like others; an empty
    table gives no rows; extra columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.store(fingerprints(docs, width), "fingerprints")
        nodes = scratch.store(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fingerprint-nodes")
        roots = scratch.store(components(near_links(nodes.select("fp"), distance, scratch)), "fingerprint-roots")
        rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        labelled = rooted.join(smallest, "root").select("fp", "rows", "component_id")
        found = spread_join(prints, labelled, "fp", prints.count())
        return scratch.result(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "near-duplicates")


# ---- one document of each group of near copies

#: Bits in which fingerprints of near copies may differ: of sets of a similarity of 0.8, 9.7 of 64 do on average and over
#: 15 in one case of fifty. ``LIKELY`` bits are those at which a pair has to meet in some order with ``RECALL``.
REACH, LIKELY, RECALL = 15, 11, 0.97
#: Bits of a bucket, at the least.
LEAST_KEY = 8


def random_orders(n: int, seed: int = 7) -> list[tuple[list[int], int]]:
    """Permutations of the 64 bits for ``n`` fingerprints, and the leading bits that make a bucket.

    Buckets have a page on average. Each order brings a pair that differs in ``LIKELY`` bits into one bucket with a
    chance that falls with the bits of a bucket; there are as many orders as make that ``RECALL`` in all, a number that
    grows with about the fourth root of ``n``.
    """
    import math
    import random

    key = max(LEAST_KEY, (max(1, n) // PAGE).bit_length())
    chance = math.comb(64 - LIKELY, key) / math.comb(64, key)
    r = random.Random(seed)
    return [(r.sample(range(64), 64), key) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - chance)))]


#: What the index is made of: the first 64 bits of a wide fingerprint, which lead, the others, the set's number, its group.
INDEXED = ["fp", "w1", "w2", "w3", "node", "root"]
PAIRS = "page boolean, rotation int, bucket int, number bigint, pattern bigint, mask bigint, root bigint, members binary, nodes binary, roots binary, u bigint, v bigint, apart int"


def _pair_batch(u, v, apart) -> pa.RecordBatch:
    import numpy as np

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = [pa.array(np.zeros(len(u), bool)), *(pa.nulls(len(u), k) for k in kinds), pa.array(u), pa.array(v), pa.array(apart.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PAIRS.split(", ")])


def _given_batch(pages: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    rows = [(True, *p, None, None, None) for p in pages]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PAIRS.split(", ")])


def close_pairs(a, b, distance: int) -> Iterator[tuple]:
    """``(i, j, apart)`` of linked pairs of two tables of wide fingerprints, or within one: at most ``distance`` bits apart
    in the first 64, and ``WIDE`` in all."""
    import numpy as np

    one = GrayIndex(a[0])
    for i, j in tree_pairs(one, one if b is a else GrayIndex(b[0]), distance):
        apart = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int64) for x, y in zip(a, b))
        keep = apart <= WIDE
        if keep.any():
            yield i[keep], j[keep], apart[keep]


def first_partners(distance: int):
    """The function of one range partition: for each row of a page, its first and its nearest partner before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for _, _, (*bits, node, _), _, _ in bucket_pages(batches):
            wide, n = [x.view(np.uint64) for x in bits], len(node)
            order = np.argsort(node, kind="stable")  # by node, the same document is the first one in all orders
            place = np.empty(n, dtype=np.int64)
            place[order] = np.arange(n)
            node, wide_by_node = node[order], [x[order] for x in wide]
            first, near = np.full(n, n, dtype=np.int64), np.full(n, 257 * n, dtype=np.int64)
            for i, j, apart in close_pairs(wide, wide, distance):
                i, j = place[i], place[j]
                low, high = np.minimum(i, j), np.maximum(i, j)
                np.minimum.at(first, high, low)
                np.minimum.at(near, high, apart * n + low)
            own = np.flatnonzero(first < n)
            if len(own):
                u, v = np.unique(np.concatenate([np.stack([first[own], own]), np.stack([near[own] % n, own])], axis=1), axis=1)
                yield _pair_batch(node[u], node[v], sum(np.bitwise_count(x[u] ^ x[v]).astype(np.int64) for x in wide_by_node))

    return run


def open_pairs(distance: int):
    """The function of one range partition: edges that connect what pairs of different roots within pages do, and pages of
    larger buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number, pages = 0, []
        for rotation, bucket, (*bits, node, root), give, pid in bucket_pages(batches):
            wide = [x.view(np.uint64) for x in bits]
            if give:
                number += 1
                one = int(root[0]) if (root == root[0]).all() else None
                pages.append((rotation, bucket, (pid << 32) + number, *shared_bits(wide[0]), one, np.stack(wide).tobytes(), node.tobytes(), root.tobytes()))
            if len(pages) == 16:
                yield _given_batch(pages)
                pages = []
            if (root != root[0]).any():
                u, v = _apart(close_pairs(wide, wide, distance), node, root)
                if len(u):
                    yield _pair_batch(u, v, np.zeros(len(u)))
        if pages:
            yield _given_batch(pages)

    return run


def _apart(pairs, node, root, offset: int = 0):
    """Edges from the smallest node of each component of the pairs of different roots to its others: never all pairs.
    The second side of the pairs begins at ``offset``."""
    import numpy as np

    labels = np.arange(len(node))
    for i, j, _ in pairs:
        keep = root[i] != root[j + offset]
        if keep.any():
            labels = merged(labels, i[keep], j[keep] + offset)
    least = node.copy()
    np.minimum.at(least, labels, node)
    least = least[labels]
    own = least != node
    return least[own], node[own]


def open_cross(distance: int):
    """Edges that connect what pairs of different roots of two pages of one bucket do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                (fa, na, ra), (fb, nb, rb) = (tuple(np.frombuffer(x, np.int64) for x in half) for half in (row[:3], row[3:]))
                wide = [list(f.view(np.uint64).reshape(4, -1)) for f in (fa, fb)]
                u, v = _apart(close_pairs(*wide, distance), np.concatenate([na, nb]), np.concatenate([ra, rb]), len(na))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _best(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.min(F.struct("apart", "u", "v")).alias("p")).select("p.u", "p.v")


def similar_groups(nodes: DataFrame, docs: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for the nodes that links join to others; ``nodes`` are distinct shingle sets, each
    with its number, its wide fingerprint, and the id and text of a document that has it.

    Links are pairs of nodes whose fingerprints differ in ``REACH`` bits at most, that meet in a bucket of some order,
    whose wide fingerprints differ in ``shingles.WIDE`` bits at most, and whose whole sets have a Jaccard similarity of
    ``num / den`` or more. First each node is checked against two of its partners. What the groups so found leave open is
    never listed by pairs, of which a large group of near copies has as many as its square: pages give out edges that
    connect the nodes of open pairs to crowds, and the sets of a crowd meet in blocks, where all its pairs are looked at.
    """
    orders = random_orders(nodes.count())

    def met(roots: DataFrame | None, function) -> DataFrame:
        rows = nodes.select(*INDEXED[:-1])
        if roots is None:
            rows = rows.withColumn("root", F.col("node"))
        else:
            rows = rows.join(roots.select("node", F.col("root").alias("r")), "node", "left").select(*INDEXED[:-1], F.coalesce("r", "node").alias("root"))
        return scratch.store(ranked(rows, orders).mapInArrow(function, PAIRS), "copies-index")

    found = met(None, first_partners(REACH)).select("u", "v", "apart")
    tried = scratch.store(found.groupBy("v").agg(F.min("u").alias("u")).select("u", "v").unionByName(_best(found, ["v"])).distinct(), "copies-tried")
    named = tried.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = member_sets(named, nodes, docs, width, scratch)
    links = scratch.store(similar_pairs(tried, sets, num, den, scratch), "copies-links")
    roots = scratch.store(linked(links), "copies-roots")
    del found
    tidy(nodes.sparkSession)
    found = met(roots, open_pairs(REACH))
    pages = found.where("page")
    different = F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))
    crossed = with_pages(scratch.store(page_pairs(pages, REACH, different), "copies-pages"), pages, "members", "nodes", "roots")
    edges = found.where("not page").select("u", "v").unionByName(crossed.mapInArrow(open_cross(REACH), "u bigint, v bigint"))
    joined = linked(scratch.store(edges.distinct(), "copies-edges")).select("node", F.col("root").alias("crowd"))
    joined = scratch.store(joined, "copies-joined")
    crowds = scratch.store(joined.unionByName(joined.select(F.col("crowd").alias("node"), "crowd").distinct()), "copies-crowds")
    if crowds.isEmpty():
        return roots
    others = scratch.store(crowds.select("node").join(named, "node", "left_anti"), "copies-others")
    if not others.isEmpty():
        sets = sets.unionByName(member_sets(others, nodes, docs, width, scratch))
    known = crowds.join(nodes.select(*INDEXED[:-1]), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = crowd_places(known, sets).groupBy("crowd", "a", "b").applyInArrow(crowd_links(num, den, REACH), "u bigint, v bigint")
    links = links.unionByName(scratch.store(more, "copies-links"))
    return scratch.store(linked(links), "copies-roots")


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each group of near copies, with all columns: that of the smallest id, by its text's digest of a tie.

    Groups are joined by links between texts whose sets of ``width``-word shingles have a Jaccard similarity of ``num /
    den`` or more, found by the Gray-order index of their fingerprints (:func:`similar_groups`) and checked on the whole
    sets. Texts without words, null ones too, are copies of each other, and so are texts with equal sets, of any length.

    A row is named by its id and its text's digest: rows that share an id with other texts are judged apart, and rows
    without an id come after all others. Of rows with equal id and text one stays, the first by its columns as JSON. An
    empty table gives an empty result.
    """
    gone_id, gone_text, key = free_names(docs, "gone_id", "gone_text", "copies_key")
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.store(shingled(docs, width), "copies-rows")
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_digest")
        bits = ["fp", "w1", "w2", "w3"]  # the same for equal sets
        grouped = rows.groupBy("digest").agg(F.min(order).alias("least"), *(F.first(c).alias(c) for c in bits))
        # numbered once, as it is written
        nodes = scratch.store(grouped.select(F.monotonically_increasing_id().alias("node"), *bits, "least"), "copies-nodes")
        named = nodes.select("node", *bits, "least.doc_id", "least.text_digest")
        roots = similar_groups(named, docs, width, num, den, scratch)
        of = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
        kept = scratch.store(of.groupBy("root").agg(F.min("least").alias("k")).select("k.doc_id", "k.text_digest"), "copies-kept")
        here = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_digest"] == b["text_digest"])
        keys = rows.groupBy("doc_id", "text_digest").agg(F.count("*").alias("rows"))
        named = [F.col("doc_id").alias(gone_id), F.col("text_digest").alias(gone_text)]
        gone = stored(keys.join(kept, here(keys, kept), "left_anti").select(*named), "copies-gone")
        twice = stored(keys.where("rows > 1").join(kept, here(keys, kept), "left_semi").select(*named), "copies-twice")
    keyed = docs.withColumn(key, copies_key("text"))

    def joined(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_text))
        return narrow_join(rows, table, same, how, F.xxhash64(key), F.xxhash64(gone_text))

    left = joined(keyed, gone, "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    row = F.struct(*docs.columns)
    once = joined(left, twice, "left_semi").groupBy("doc_id", key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return joined(left, twice, "left_anti").select(*docs.columns).unionByName(once)

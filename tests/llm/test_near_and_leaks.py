import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from narrative_spark.llm import decontaminate, runtime, sharding, shingles, simhash
from narrative_spark.llm.components import components
from narrative_spark.llm.runtime import Scratch

from .conftest import prose


def brute_components(prints, distance=4):
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_print(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(documents):
    r = random.Random(3)
    texts = ["", None, " \n\t", "one", "two words", "One", "ÉTÉ ünd　x y z w"]
    for k in range(25):
        base = prose(k, 150).split()
        texts += [" ".join(base)] * (k % 3)
        for _ in range(6):
            near = list(base)
            for _ in range(r.randint(0, 3)):
                near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    rows = [(7 * k + 1, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    got = {x.doc_id: x for x in simhash.near_duplicates(documents(rows)).collect()}
    rows.sort()
    prints = [brute_print(t) for _, t in rows]
    assert [int(got[d].fingerprint, 16) for d, _ in rows] == prints
    assert [got[d].component_id for d, _ in rows] == [rows[k][0] for k in brute_components(prints)]
    assert simhash.near_duplicates(documents([])).count() == 0


def test_hot_bucket_over_many_pages(spark, monkeypatch):
    r = np.random.default_rng(5)
    values = {int(x) for x in r.integers(0, 2**63, 300)}
    center = int(r.integers(0, 2**63))
    for _ in range(500):
        x = center
        for b in r.choice(64, int(r.integers(0, 5)), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(values)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    whole = np.asarray(values, dtype=np.uint64)
    want = simhash._small_labels(whole, 4)
    monkeypatch.setattr(simhash, "PAGE", 64)
    table = spark.createDataFrame([(signed(x),) for x in values], "fp long").coalesce(1)
    # pages are cut on this side: one partition's function, called as Spark does
    index = {signed(x): k for k, x in enumerate(values)}
    for blocks in (None, 6, 7):
        with Scratch(spark) as scratch:
            edges = simhash.near_links(table, 4, scratch, blocks).collect()
        got = simhash.merged(np.arange(len(values)), np.array([index[e.u] for e in edges]), np.array([index[e.v] for e in edges]))
        assert (got == want).all()
    assert (simhash.page_labels(whole, 4) == want).all()


def test_orders_follow_the_number_of_fingerprints():
    assert [len(simhash.block_orders(n, 4)) for n in (0, 10**6, 10**9, 10**12)] == [5, 5, 15, 35]
    for n in (10, 10**7, 10**10):
        for order, bits in simhash.block_orders(n, 4):
            assert sorted(order) == list(range(64)) and 0 < bits < 31
    small, large = simhash.random_orders(1000), simhash.random_orders(10**9)
    assert small[0][1] == 8 and large[0][1] == 18 and len(small) < len(large) < 200


def near_copies_of(seed, n, edits):
    """Texts of ``n`` words: a base and copies with some words changed."""
    r, base = random.Random(seed), prose(seed, n).split()
    for k in edits:
        words = list(base)
        for at in r.sample(range(n), k):
            words[at] = f"edit{r.randrange(10**6)}"
        yield " ".join(words)


def brute_groups(texts, width=5):
    """Components of all pairs of a similarity of 0.8 or more, by comparing all sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    n, labels = len(sets), np.arange(len(sets))
    pairs = [(i, j) for j in range(n) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    if pairs:
        labels = simhash.merged(labels, *(np.array(x) for x in zip(*pairs)))
    return labels, pairs


@pytest.mark.parametrize("dense", [0, 4])
def test_near_copies_against_brute_force(documents, monkeypatch, dense):
    monkeypatch.setattr(shingles, "DENSE", dense)
    monkeypatch.setattr(shingles, "BLOCK", 16)
    texts = ["", None, " \n", "one", "One", "two words", "two  WORDS", "only three words", "a long tale " * 4000]
    for k in range(40):
        texts += near_copies_of(k, 150, [0, 1, 2, 2, 3, 3])
        texts.append(prose(1000 + k, 150))
    texts += near_copies_of(99, 400, [0] + [4] * 120)  # a large group whose members are all alike
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    labels, pairs = brute_groups(texts)
    monkeypatch.setattr(simhash, "PAGE", 64)
    kept = simhash.keep_one(documents(random.Random(5).sample(rows, len(rows))))
    assert kept.columns == documents([]).columns
    got, want = {r.doc_id for r in kept.collect()}, {rows[k][0] for k in range(len(rows)) if labels[k] == k}
    assert want <= got and len(got - want) <= 0.02 * (len(rows) - len(want))  # nothing else goes, and all but all copies do


def test_rows_of_a_large_group(documents, monkeypatch):
    """Edited copies that are near, but no links, of each other: no table on the way grows with the square of their number."""
    written, store = {}, Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "store", counted)
    most = {}
    for n in (150, 600):
        texts = list(near_copies_of(99, 150, [0] + [1, 3, 5, 4] * (n // 4)))
        labels, _ = brute_groups(texts)
        written.clear()
        kept = {r.doc_id for r in simhash.keep_one(documents(list(enumerate(texts)))).collect()}
        want = {k for k in range(len(texts)) if labels[k] == k}
        assert want <= kept and len(kept - want) <= 0.02 * (len(texts) - len(want))
        most[n] = dict(written)
    assert all(most[600][name] <= 6 * max(count, 150) for name, count in most[150].items() if name in most[600]), most  # the square is 16
    assert max(most[600].values()) <= 40 * 600


@pytest.mark.parametrize("crowded", [1, 128])
def test_crowds_in_blocks(documents, monkeypatch, crowded):
    """Crowds that are cut into many blocks give the same groups as whole ones."""
    monkeypatch.setattr(shingles, "BLOCK", crowded)
    monkeypatch.setattr(shingles, "ROOT", 1)
    texts = [t for k in range(4) for t in near_copies_of(k, 150, [0] + [1, 2, 3, 4] * 15)]
    rows, (labels, _) = list(enumerate(texts)), brute_groups(texts)
    kept = {r.doc_id for r in simhash.keep_one(documents(rows)).collect()}
    want = {k for k in range(len(texts)) if labels[k] == k}
    assert want <= kept and len(kept - want) <= 0.02 * (len(rows) - len(want))


def test_links_of_a_place():
    """All links of a place, within a block and across two, against the sets themselves."""
    import pyarrow as pa

    r = random.Random(8)
    texts = [t for k in range(3) for t in near_copies_of(k, 120, [0, 1, 2, 3, 4] * 6)] + ["one", "one two", ""]
    sets = [np.unique(shingles.shingle_hashes(t.encode(), 5)) for t in texts]
    wide = np.array([shingles.wide_bits(s) for s in sets], dtype=np.uint64).view(np.int64)
    n, block = len(sets), np.array([r.randint(0, 1) for _ in sets])
    node = np.array(r.sample(range(10**6), n))
    for a, b in ((0, 0), (0, 1), (1, 1)):
        here = np.flatnonzero((block == a) | (block == b))
        columns = {"node": node[here], "root": node[here], "block": block[here], "a": np.full(len(here), a), "b": np.full(len(here), b)}
        columns |= {c: wide[here, k] for k, c in enumerate(("fp", "w1", "w2", "w3"))}
        table = pa.table({**{c: pa.array(x, pa.int64()) for c, x in columns.items()}, "members": pa.array([sets[k].tobytes() for k in here], pa.binary())})
        index = {x: k for k, x in enumerate(node[here].tolist())}
        got = crowd_labels(index, shingles.crowd_links(4, 5, 64)(table).to_pylist(), len(here))
        alike = lambda x, y: 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))
        pairs = [{"u": int(node[x]), "v": int(node[y])} for x in here for y in here if x < y and (a == b or block[x] != block[y]) and alike(sets[x], sets[y])]
        assert pairs and (got == crowd_labels(index, pairs, len(here))).all()


def crowd_labels(index, edges, n):
    return simhash.merged(np.arange(n), np.array([index[e["u"]] for e in edges]), np.array([index[e["v"]] for e in edges]))


@pytest.mark.parametrize("small", [0, 400_000])
def test_rows_that_share_an_id(documents, monkeypatch, small):
    monkeypatch.setattr(runtime, "SMALL", small)  # tables that are broadcast, or larger ones
    text, other = prose(1, 120), prose(2, 120)
    rows = [(5, text), (3, text), (9, text), (9, other), (9, other), (None, prose(3, 120)), (None, prose(4, 120)), (None, other), (12, other + " end"), (12, prose(5, 120))]
    kept = simhash.keep_one(documents(rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", text), ("9", other), ("12", prose(5, 120)), ("None", prose(3, 120)), ("None", prose(4, 120))])
    assert simhash.keep_one(documents([])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (6, 7), (7, 7), (2, 1)] + [(100 + k, 101 + k) for k in range(30)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 6: 4, 7: 4} | {101 + k: 100 for k in range(30)}
    assert components(edges.where("u < 0")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_few_edges_and_many(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (2, 1)] + [(100 + k, 101 + k) for k in range(9)], "u long, v long")
    assert {r.node: r.root for r in simhash.linked(edges).collect()} == {2: 1, 3: 1, 5: 4, 6: 4} | {101 + k: 100 for k in range(9)}
    assert simhash.linked(edges.where("u < 0")).count() == 0


def brute_leaks(docs, items, width=10):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            q = words(item)
            n = min(width, len(q))
            if not n:
                continue
            windows = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_leaks_against_brute_force(spark, documents):
    items = [(1, prose(50, 30)), (2, prose(51, 12)), (3, "Short Item"), (4, ""), (5, None), (6, "..."), (7, prose(50, 30)), (11, "solo"), (12, "the the the the the the the the the the the the")]
    long = prose(50, 30).split()
    docs = [
        (1, prose(60, 40) + " " + prose(50, 30) + "! " + prose(61, 20)),
        (2, prose(62, 40)),
        (3, ", ".join(long[5:16]) + ". x " + " ".join(long[3:12])),
        (4, "a short ITEM here, short\n\nitem! short x item"),
        (5, None), (6, ""), (7, "?!"), (8, "solo"), (9, "the " * 40), (10, "Ünï " + prose(51, 12).upper() + " É"), (11, " ".join(long[:9]) + " x " + " ".join(long[9:])), (12, prose(50, 30) * 30),
    ]
    table = spark.createDataFrame([(*i, 1, "t") for i in items], "item_id long, text string, n int, term string")
    got = decontaminate.contamination(documents(docs), table).collect()
    assert sorted(tuple(r) for r in got) == brute_leaks(docs, items)
    assert all(not r.contaminated for r in decontaminate.contamination(documents(docs), table.where("item_id < 0")).collect())
    assert decontaminate.contamination(documents([]), table).count() == 0
    kept = decontaminate.drop_contaminated(documents(docs), table)
    assert {r.doc_id for r in kept.collect()} == {2, 5, 6, 7, 11} - {d for d, *_, c in brute_leaks(docs, items) if c}
    assert kept.columns == documents([]).columns
    shared = documents([(1, prose(62, 40)), (1, prose(50, 30)), (None, prose(50, 30)), (None, "x"), (2, None)])
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.drop_contaminated(shared, table).collect()) == sorted([("1", prose(62, 40)), ("None", "x"), ("2", None)], key=str)
    assert decontaminate.drop_contaminated(documents([]), table).count() == 0


def test_salted_words_and_no_filter(spark, documents, monkeypatch):
    monkeypatch.setattr(runtime, "SMALL", 0)
    items = [(1, prose(50, 30)), (2, "solo")]
    docs = [(k, prose(60 + k, 20) + " " + (prose(50, 30) if k % 3 else "solo")) for k in range(12)]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1)
    assert sorted(tuple(r) for r in decontaminate.contamination(documents(docs), table).collect()) == brute_leaks(docs, items)
    clean = [(50, prose(99, 30)), (51, None)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(documents(docs + clean), table).collect()} == {50, 51}


def test_repeated_ids_are_counted_apart(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = decontaminate.contamination(documents([(1, "alpha beta"), (1, "beta alpha"), (1, "alpha beta")]), items).collect()
    assert sorted(r.n_hit for r in got) == [0, 2, 2]


def test_proximity(spark, documents):
    vocabulary = spark.createDataFrame([("alpha",), ("omega",)], "term string")
    index = decontaminate.build_index(documents([(1, "alpha x x omega x x x x x alpha"), (2, "omega alpha")]), vocabulary)
    got = {(r.pos_left, r.pos_right) for r in decontaminate.proximity_matches(index, "alpha", "omega", 3).collect()}
    assert got == {(0, 3), (1, 0)}


def brute_minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        n, room = 1, mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        low, high = (mid + 1, high) if n > shards else (low, mid)
    return low


def test_shards(spark, documents):
    r = random.Random(9)
    texts = [prose(k, r.randint(1, 80)) for k in range(300)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:20] + ["hot copy of a text"] * 150 + ["", None, ""])]
    got = sharding.shard(documents(rows), 8).collect()
    text = dict(rows)
    assert sorted(x.doc_id for x in got) == sorted(text)
    where, shards = {}, {}
    for x in got:
        data = (text[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert where.setdefault(data, x.shard) == x.shard
        shards.setdefault(x.shard, []).append(x)
    for members in shards.values():
        assert sorted(x.slot for x in members) == list(range(len(members)))
    groups = {}
    for _, t in rows:
        d = (t or "").encode()
        groups[hashlib.sha256(d).digest()] = groups.get(hashlib.sha256(d).digest(), 0) + len(d) + 8
    total = sum(groups.values())
    giants = 0
    for size in sorted(groups.values(), reverse=True)[:7]:
        if size * (8 - giants) < total:
            break
        total, giants = total - size, giants + 1
    rest = [s for d, s in sorted(groups.items())]
    for size in sorted(groups.values(), reverse=True)[:giants]:
        rest.remove(size)
    load = {k: sum(x.size for x in v) for k, v in shards.items()}
    assert max(v for k, v in load.items() if k >= giants) == brute_minimax(rest, 8 - giants)
    assert len(load) == 8


def test_few_and_no_groups(documents):
    assert sharding.shard(documents([]), 8).count() == 0
    assert {r.shard for r in sharding.shard(documents([(1, "a"), (2, "a"), (3, None)]), 8).collect()} <= set(range(8))
    assert sorted(r.slot for r in sharding.shard(documents([(1, "a")] * 5), 8).collect()) == [0, 1, 2, 3, 4]


def test_refined_bins_are_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BINS", 4)
    monkeypatch.setattr(sharding, "FAN", 4)
    r = random.Random(1)
    sizes = [r.randint(1, 500) for _ in range(200)]
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append(at)
    table = spark.createDataFrame([(e,) for e in ends], "end long").persist()
    cuts = sharding.minimax_cuts(sharding.RunningSums(table, at), 6, max(sizes))
    assert set(cuts) <= set(ends) and cuts[-1] == at
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == brute_minimax(sizes, 6)

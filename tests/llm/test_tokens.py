import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from narrative_spark.llm import encoding
from narrative_spark.llm.packing import cut_pieces, pack_documents, plan_packing
from narrative_spark.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from narrative_spark.llm import token_counts, token_files
from narrative_spark.llm.token_counts import count_tokens
from narrative_spark.llm.token_files import read_token_files, token_file_table

from .conftest import prose

ODD = ["", None, " ", "a  b\n\nc \n d", "x <|endoftext|> y", "tab\tand\r\nreturn", "Größe ñandú ÉTÉ!", "漢字 かな ΑΣ", "word " * 9000, "a" * 30000, "same", "same"]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.tokenizer_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = st.lists(st.sampled_from(list("abcE1! .,'\n\t\r　́é漢<|>") + [" the", "<|endoftext|>", "İ", "  "]), max_size=40).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_encoders_agree_with_the_library(text):
    for kind, name, form in (("word", WORD_VOCABULARY, str.encode), ("byte", BYTE_VOCABULARY, str)):
        e = encoding.encoder(kind, name)
        assert np.frombuffer(next(iter(e.encode([form(text)]))), "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_full_memo_changes_nothing():
    e = encoding.WordEncoder(encoding.tokenizer_path(WORD_VOCABULARY))
    e.memo.most = e.parts.most = 3
    texts = [prose(k) for k in range(5)]
    assert [len(x) // 4 for x in e.encode(t.encode() for t in texts)] == [len(library(WORD_VOCABULARY)(t)) for t in texts]


def test_words_of_a_line_are_told_apart(monkeypatch):
    """New words go to the library as lines; each one's ids are those that it has alone."""
    words = sorted({w for k in range(40) for w in prose(k, 60).split()} | {"été", "größe", "a", "ñandú", "straße", "ªº"})
    e = encoding.WordEncoder(encoding.tokenizer_path(WORD_VOCABULARY))
    monkeypatch.setattr(e, "_part", None)  # so that no word is asked for alone
    got = e.learn(words)
    assert len(got) == len(words) > 300 and all(np.frombuffer(ids, "<u4").tolist() == e.library.encode(w, add_special_tokens=False).ids for w, ids in got.items())


def test_safe_pieces_keep_all_bytes():
    data = (prose(1, 500) + "x" * 400 + " " + prose(2, 50)).encode()
    pieces = list(encoding.safe_pieces(data, 100))
    assert b"".join(pieces) == data and len(pieces) > 10
    assert list(encoding.by_bytes([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)]


def test_counts(documents):
    ids = library(WORD_VOCABULARY)
    got = {r.doc_id: r for r in count_tokens(documents(list(enumerate(ODD))), WORD_VOCABULARY, limit=100, batch_bytes=64).collect()}
    for k, text in enumerate(ODD):
        assert (got[k].n_bytes, got[k].n_tokens) == (len((text or "").encode()), len(ids(text)))
        assert got[k].over_limit == (got[k].n_tokens > 100)
    assert count_tokens(documents([]), WORD_VOCABULARY).count() == 0


def test_batches_are_balanced_by_bytes(monkeypatch):
    calls = []
    c = token_counts.PieceCounts(WORD_VOCABULARY, most=50)
    real = c.lengths
    monkeypatch.setattr(c, "lengths", lambda fresh: calls.append(fresh) or real(fresh))
    texts = [prose(k, 30).encode() for k in range(40)] + [prose(50, 3000).encode(), b"x" * 5000]
    ids = library(WORD_VOCABULARY)
    assert c.count(texts, 2000) == [len(ids(t.decode())) for t in texts]
    assert len(calls) > 10 and all(len(set(x)) == len(x) for x in calls) and len(c.known) <= 50


def test_files_with_other_settings_are_encoded_whole(documents, tmp_path):
    import json

    with open(encoding.tokenizer_path(WORD_VOCABULARY), encoding="utf-8") as f:
        own = json.load(f)
    own["pre_tokenizer"]["pretokenizers"][0] = {"type": "Split", "pattern": {"Regex": "[a-z]+ [a-z]+|[a-z]+"}, "behavior": "Removed", "invert": True}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(own, f)
    assert encoding.cut_here("word", encoding.tokenizer_path(WORD_VOCABULARY)) and encoding.cut_here("byte", encoding.tokenizer_path(BYTE_VOCABULARY))
    assert not encoding.cut_here("word", path) and not encoding.cut_here("word", encoding.tokenizer_path(BYTE_VOCABULARY))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(list(enumerate(ODD))), path).collect()}
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(ODD)}


def test_sentencepiece_files(documents):
    import sentencepiece

    path = encoding.tokenizer_path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents(list(enumerate(ODD))), path).collect()}
    assert got == {k: len(p.encode(x or "")) for k, x in enumerate(ODD)}


def test_rows_that_share_an_id(documents):
    rows = [(1, "b"), (1, "a longer text"), (1, None), (0, "first"), (1, "b"), (2, "last")]
    ids = library(BYTE_VOCABULARY)
    got = sorted(token_file_table(documents(rows), BYTE_VOCABULARY, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [0, 1, 1, 1, 1, 2] and sorted(r.n_tokens for r in got) == sorted(len(ids(t)) + 1 for _, t in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    again = sorted(token_file_table(documents(rows[::-1]), BYTE_VOCABULARY, 2).collect(), key=lambda r: r.start)
    assert got == again


def test_bloom_filters_and_stripes(spark, documents, tmp_path):
    """Files have Bloom filters and statistics of ids, and a look-up by id reads a few strides of rows only."""
    import glob

    path = f"{tmp_path}/big"
    token_files.write_token_files(documents([(2 * k, f"text {k}") for k in range(40000)]), f"file://{path}", BYTE_VOCABULARY, 2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    orc, bloom = jvm.org.apache.orc, 0
    for file in glob.glob(f"{path}/*.orc"):
        reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), orc.OrcFile.readerOptions(conf))
        assert reader.getCompressionKind().toString() == "ZSTD" and reader.getRowIndexStride() == 1000 and reader.getStripeStatistics().size() == reader.getStripes().size() > 0
        records = reader.rows()
        for stripe in reader.getStripes():
            streams = records.readStripeFooter(stripe).getStreamsList()
            bloom += sum(x.getKind().toString().startswith("BLOOM_FILTER") and x.getColumn() == 1 for x in streams)
        records.close()
    assert bloom >= len(glob.glob(f"{path}/*.orc"))
    found = read_token_files(spark, f"file://{path}")
    for wanted, most in ((40000, 1000), (40001, 0)):  # the second one lies between two ids: the filter knows it isn't there
        hit = found.where(f"doc_id = {wanted}").select("doc_id", "n_tokens")
        assert hit.count() == (wanted % 2 == 0)
        plan = hit._jdf.queryExecution()
        hit._jdf.rdd().count()
        scan = next(x for x in _nodes(plan.executedPlan()) if "FileSourceScan" in x.getClass().getName())
        assert scan.metrics().apply("numOutputRows").value() <= most + 1000 * (most == 0)


def _nodes(plan):
    """All nodes of a plan, below adaptive ones too."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _nodes(plan.executedPlan())
    children = plan.children()
    return [plan, *(x for k in range(children.size()) for x in _nodes(children.apply(k)))]


def test_token_files(spark, documents, tmp_path):
    ids = library(BYTE_VOCABULARY)
    rows = [(3 * k - 5, t) for k, t in enumerate(ODD)]
    path = f"file://{tmp_path}/tokens"
    got = sorted(token_file_table(documents(rows), BYTE_VOCABULARY, 2, path).collect())
    start = 0
    for (doc_id, text), r in zip(sorted(rows), got):
        want = np.asarray([*ids(text), 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    # files follow the order of ids, and the metadata of a stripe prunes by id
    import glob

    from pyarrow import orc

    firsts = [orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist() for f in sorted(glob.glob(f"{tmp_path}/tokens/*.orc"))]
    assert [x for f in firsts for x in f] == sorted(d for d, _ in rows)
    found = read_token_files(spark, path).where("doc_id = 4")
    assert found.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in found._jdf.queryExecution().toString()
    assert token_file_table(documents([]), BYTE_VOCABULARY, 2).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, n = [0] * (capacity + 1), 0
    for length in sorted(lengths, reverse=True):
        g = next((g for g in range(length, capacity + 1) if gaps[g]), None)
        if g is None:
            n, g = n + 1, capacity
        else:
            gaps[g] -= 1
        gaps[g - length] += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_as_good_as_best_fit_decreasing(histogram):
    placed, n = plan_packing(histogram, 40)
    fill, seen = {}, {}
    for length, rank, count, first, offset in placed:
        for k in range(count):
            assert (length, rank + k) not in seen
            seen[(length, rank + k)] = True
            assert fill.get(first + k, 0) == offset  # gapless
            fill[first + k] = offset + length
    assert len(seen) == sum(histogram.values()) and len(fill) == n and all(v <= 40 for v in fill.values())
    assert n <= 1.06 * best_fit_decreasing([x for x, c in histogram.items() for _ in range(c)], 40) + 1


def test_packing(documents):
    ids = library(WORD_VOCABULARY)
    rows = list(enumerate(ODD)) + [(100 + k, prose(k, 5 + k)) for k in range(40)] + [(200, "same"), (200, "same")]
    got = pack_documents(documents(rows), WORD_VOCABULARY, 1, 256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        if r.doc_id != 200:
            by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows[:-2]:
        want = [*ids(text), 1]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.length for r in pieces] == [len(want[k : k + 256]) for k in range(0, len(want), 256)]
        for r in pieces:
            assert r.start == 256 * r.piece and r.ids_crc32 == zlib.crc32(np.asarray(want[r.start : r.start + 256], "<u4").tobytes())
    assert sum(r.doc_id == 200 for r in got) == 2
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_sequence) <= best_fit_decreasing([r.length for r in got], 256) + 1
    assert pack_documents(documents([]), WORD_VOCABULARY, 1, 256).count() == 0


def test_pieces_of_an_empty_batch(documents):
    assert cut_pieces(documents([(1, None)]), WORD_VOCABULARY, 1, 8).collect()[0][:4] == (1, 0, 0, 1)


def test_unknown_vocabulary():
    with pytest.raises(Exception):
        encoding.encoder("word", "/nowhere/none.json")

import hashlib
import random
import zlib

import numpy as np
import pytest

from narrative_spark.llm import html_text, language_id, matroska, sampling, toxicity
from narrative_spark.llm.boosting import BoostedTrees

from .conftest import prose

WORDS = {"en": "the and of with which there house water mother never under", "de": "der und von mit welche dort haus wasser mutter nie unter sein", "fr": "le et de avec laquelle maison eau mère jamais sous être où"}


def speech(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def brute_phrases(text, model):
    n, at = 0, 0
    while at < len(model):
        k = 1
        while at + k <= len(model) and model[at : at + k] in text:
            k += 1
        at, n = at + max(1, k - 1), n + 1
    return n


def test_cross_parsing_against_brute_force():
    sample = language_id.letters_only(speech("en", 1, 80))
    m = language_id.LanguageModel({"en": sample, "de": language_id.letters_only(speech("de", 1, 80))})
    for text in (speech("en", 2, 20), speech("de", 3, 20), "xyz qqq", "a"):
        lanes = m.lanes(text)[: language_id.LANE]
        got = language_id.cross_phrases(m.automata[1], m.own[1][lanes][None, :], np.array([len(lanes)]))[0]
        assert got == brute_phrases(sample, language_id.letters_only(text)[: language_id.LANE])


def test_hash_tables_follow_like_dense_ones():
    r = random.Random(8)
    text = [r.randrange(300) for _ in range(3000)]
    dense, sparse = language_id.SuffixAutomaton(text, 301, 1 << 24), language_id.SuffixAutomaton(text, 301, 0)
    assert dense.keys is None and sparse.table is None and len(sparse.keys) < 8 * 3 * len(text)
    state, c = np.random.default_rng(1).integers(0, len(dense.table), 20000), np.random.default_rng(2).integers(0, 301, 20000)
    assert (dense.follow(state, c) == sparse.follow(state, c)).all() and (dense.table >= 0).sum() == (sparse.keys >= 0).sum()
    moves = np.argwhere(dense.table >= 0)
    assert (sparse.follow(moves[:, 0], moves[:, 1]) == dense.table[moves[:, 0], moves[:, 1]]).all()


def test_letters_beyond_the_first_plane():
    gothic, osage = "".join(map(chr, range(0x10330, 0x10340))), "".join(map(chr, range(0x104D8, 0x104E8)))
    m = language_id.LanguageModel({"got": gothic * 5, "osa": osage * 5})
    assert [x[0] for x in m.predict([gothic[3:9], osage[2:8], "12 .", None])] == ["got", "osa", "und", "und"]


def test_a_corpus_of_long_texts_is_learnt(documents):
    """Labelled texts are all longer than the sample takes: pieces of them are learnt."""
    rows = [(k, speech(lang, k, 2500), lang) for k, lang in enumerate(["en", "de"] * 20)]
    got = language_id.identify(documents(rows)).collect()
    assert all(r.lang_pred == dict((k, lang) for k, _, lang in rows)[r.doc_id] for r in got)


def test_samples_are_bounded_and_repeatable(spark, documents):
    rows = [(k, f"text {k} " + "x" * (50 if k % 3 else 500), "hot" if k % 10 else "rare") for k in range(3000)] + [(7, "other", "hot"), (None, "no id", "hot")]
    table = documents(rows)
    labels = table.selectExpr("doc_id", "lang as label")
    one, two = (sampling.sample_texts(t, labels, 40, 200) for t in (table, table.orderBy("n_chars", "text").coalesce(1)))
    assert one == two and {label: sum(x == label for _, x in one) for label in ("hot", "rare")} == {"hot": 40, "rare": 40}
    assert all(len(t.encode()) <= 200 for t, _ in one) and not any(zlib.crc32(t.split()[1].encode()) % 4 == 2 for t, _ in one if t[:4] == "text" and "x" in t)
    assert sampling.sample_texts(table, labels.where("label = 'none'"), 5, 200) == []


def test_language_of_documents(documents):
    rows = [(k, speech(lang, k), lang) for k, lang in enumerate(list(WORDS) * 30)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 ... 34", "en"), (503, speech("de", 7, 3000), None), (504, speech("fr", 9), "fr"), (504, speech("fr", 9), "fr")]
    got = language_id.identify(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (500, 501, 502)) and by[503].lang_pred == "de"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    known = [(by[k].lang_pred, lang) for k, _, lang in rows[:90]]
    assert sum(a == b for a, b in known) >= 88
    kept = language_id.keep_identified(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, *_ in rows if k not in (500, 501, 502))
    assert language_id.identify(documents([])).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents([(2, "abc", None)])).collect()} == {"und"}


def brute_chain(emission, transition):
    """Marginals and partition by summing over all paths."""
    import itertools

    n, total, ones = len(emission), 0.0, np.zeros(len(emission))
    for path in itertools.product((0, 1), repeat=n):
        s = sum(e for e, y in zip(emission, path) if y) + sum(transition[a][b] for a, b in zip(path, path[1:]))
        total += np.exp(s)
        ones += np.exp(s) * np.array(path)
    return ones / total, np.log(total)


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(1)
    lengths, t = np.array([7, 5, 1]), ((0.5, -1.0), (-0.3, 0.8))
    e = np.zeros((3, 7))
    for k, n in enumerate(lengths):
        e[k, :n] = r.normal(size=n)
    f, b, z = toxicity.chain_marginals(e, t, lengths)
    for k, n in enumerate(lengths):
        want, log_z = brute_chain(e[k, :n], t)
        assert np.allclose(toxicity.sigmoid(f + b)[k, :n], want) and np.isclose(z[k], log_z)


@pytest.fixture(scope="module")
def toxic_rows():
    rows, labels = [], []
    for k in range(400):
        words = prose(k, 40).split()
        y = k % 4 == 0
        if y:
            for _ in range(3):
                words[random.Random(k).randrange(40)] = random.Random(k).choice(("scoundrel", "scoundrels", "blockhead", "blockheads"))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(y)))
    return rows, labels


def test_toxicity(spark, documents, toxic_rows):
    rows, labels = toxic_rows
    rows = [*rows, (900, None), (901, ""), (902, "..."), (903, prose(1, 5000) + " blockhead scoundrel"), (904, rows[0][1]), (904, rows[0][1])]
    table = spark.createDataFrame([*labels, (0, 1, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(documents(rows), table).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [(by[k].predicted, int(k % 4 == 0)) for k in range(400) if by[k].held_out]
    assert len(held) > 50 and all(a == b for a, b in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[900].score == by[901].score == by[902].score and by[900].predicted == 0
    text = dict(rows)
    assert {text[0][s.start : s.end].split()[0] for s in by[0].spans} <= {"scoundrel", "scoundrels", "blockhead", "blockheads"} and by[0].spans
    kept = {r.doc_id for r in toxicity.drop_toxic(documents(rows), table).collect()}
    assert 900 in kept and 0 not in kept and all(k in kept for k in range(400) if k % 4)
    none = toxicity.score_documents(documents(rows[:5]), table.where("toxic = 5")).collect()
    assert len({r.score for r in none}) == 1 and none[0].predicted == 0
    assert toxicity.score_documents(documents([]), table).count() == 0


def test_toxicity_of_long_texts_only(spark, documents):
    rows, labels = [], []
    for k in range(240):
        words = prose(k, 4000).split()
        if k % 3 == 0:
            for at in random.Random(k).sample(range(4000), 400):
                words[at] = random.Random(at).choice(("scoundrel", "blockhead"))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 3 == 0)))
    got = toxicity.score_documents(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r.predicted == int(r.doc_id % 3 == 0) for r in got if r.held_out]
    assert len(held) > 30 and all(held)


def test_toxicity_query_against_plain_steps(documents, toxic_rows):
    """Scores and spans of the query equal those of all paths of each chain, summed one by one."""
    rows, labels = toxic_rows
    model = toxicity.ToxicityModel().train([(t, y) for (_, t), (_, _, y) in zip(rows[:300], labels)])
    short = [(k, " ".join(t.split()[:9])) for k, t in rows[:25]]
    got = {r.doc_id: r for r in toxicity.score_documents(documents(short), None, model=model).collect()}
    for k, text in short:
        p, _ = brute_chain([model.emission(w) for w in toxicity.TOKEN.findall(text)], model.transition)
        w, odds = model.score_weights, np.log(p.max() / (1 - p.max()))
        want = toxicity.sigmoid(w[0] + w[1] * np.log(p.sum() + 1e-4) + w[2] * np.log(len(p) + 1) + w[3] * np.clip(odds, -20, 20))
        assert np.isclose(got[k].score, want, atol=1e-6) and sum(len(text[s.start : s.end].split()) for s in got[k].spans) == (p > 0.5).sum()


def test_matroska_round_trip():
    for n in (0, 1, 63, 64, 65, 255, 256, 257, 511, 2048, 2049, 32768, 32769, 70000):
        payload = matroska.pad(bytes(k * 7 % 251 for k in range(n)))
        data = matroska.mux(payload)
        m = matroska.parse(data)
        assert len(payload) % 64 == 0 and payload and not m.damaged
        assert b"".join(data[p[2] : p[2] + p[3]] for p in m.packets) == payload
        assert [p[1] for p in m.packets] == [k * matroska.FRAME_NS for k in range(len(m.packets))]
        assert sorted(at for _, _, at in m.cues) == m.clusters


def test_matroska_foreign_layouts():
    frames = [b"a" * 300, b"b" * 2, b"c" * 40]
    xiph = b"\x81\x00\x00\x02" + bytes([2, 255, 45, 2]) + b"".join(frames)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, xiph))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.uint(matroska.CLUSTER_TIMESTAMP, 5) + group  # of unknown size
    cues = matroska.element(matroska.CUES, b"")
    data = matroska.element(matroska.SEGMENT, matroska.element(matroska.VOID, b"xx") + matroska._TRACKS + cluster + cues)
    m = matroska.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in m.packets] == frames and {p[5] for p in m.packets} == {"xiph"} and m.packets[0][1] == 5_000_000
    mixed = matroska.lace(frames, 1, 0)
    m = matroska.parse(matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, mixed)))
    assert [p[3] for p in m.packets] == [300, 2, 40] and {p[5] for p in m.packets} == {"ebml"}
    good = matroska.mux(matroska.pad(b"x" * 5000))
    for cut in range(0, len(good), 37):
        assert len(matroska.parse(good[:cut]).packets) <= len(matroska.parse(good).packets)
    assert matroska.parse(b"not media at all").packets == []


def test_matroska_damage_never_raises(spark):
    E, uint, U = matroska.element, matroska.uint, matroska.size_bytes
    deep = b""
    for _ in range(3000):
        deep = E(matroska.BLOCK_GROUP, deep)
    long_time = matroska.CLUSTER_TIMESTAMP.to_bytes(1, "big") + U(12) + b"\x7f" * 12
    block = E(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    far = E(matroska.CLUSTER, uint(matroska.CLUSTER_TIMESTAMP, (1 << 62)) + block)
    scale = E(matroska.INFO, uint(matroska.TIMESTAMP_SCALE, 1 << 40))
    cases = [
        E(matroska.SEGMENT, deep + E(matroska.CLUSTER, block)), E(matroska.SEGMENT, E(matroska.CLUSTER, block + long_time + block)), E(matroska.SEGMENT, scale + far),
        E(matroska.SEGMENT, E(matroska.INFO, E(matroska.DURATION, b"xyz")) + E(matroska.CLUSTER, block)),
    ]
    found = [matroska.parse(c) for c in cases]
    assert [len(m.packets) for m in found] == [1, 1, 0, 0] and [m.damaged for m in found] == [False, True, True, True]
    table = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "doc_id long, media binary")
    assert sorted(r.doc_id for r in matroska.packet_table(table).collect()) == [0, 1]
    r = random.Random(3)
    good = matroska.mux(matroska.pad(prose(1, 400).encode()))
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(r.randint(1, 6)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        matroska.feature(matroska.parse(bytes(bad)))
    info = good[good.index(matroska.INFO.to_bytes(4, "big")) :]
    assert matroska.MUXING_APP.to_bytes(2, "big") in info and matroska.WRITING_APP.to_bytes(2, "big") in info  # mandatory


def test_media_table(spark, documents):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "Größe " * 3000), (5, "same"), (6, "same"), (5, "same")]
    got = matroska.media_table(documents(rows)).collect()
    assert len(got) == len(rows)
    by, text = {r.doc_id: r for r in got}, dict(rows)
    for k, r in by.items():
        payload = matroska.pad((text[k] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((text[k] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(matroska.mux(payload)).hexdigest()
    assert by[5][1:] == by[6][1:]
    packets = matroska.packet_table(matroska.encode_media(documents(rows[:4]))).collect()
    assert sum(p["size"] for p in packets) == sum(by[k].payload_bytes for k in (1, 2, 3, 4))
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert matroska.packet_table(broken).count() == 0 and matroska.media_table(documents([])).count() == 0


def test_boosting():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    m = BoostedTrees(rounds=30).fit(x[:1500], y[:1500])
    assert ((m.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


@pytest.fixture(scope="module")
def page_model():
    return html_text.fit(None, made=250)


def test_pages_of_unseen_layouts(page_model):
    r, tp, fp, fn = html_text._Random(12345), 0, 0, 0
    for _ in range(150):
        page = html_text.training_page(r)
        order, own = html_text._marked_tree(page)
        want = {n.text for n, y in zip(order, own) if n.tag == "#text" and y}
        got = set(page_model.extract([page.replace(' k="1"', "")])[0].split("\n\n"))
        tp, fp, fn = tp + len(want & got), fp + len(got - want), fn + len(want - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


def test_decoding_has_no_contradiction(page_model):
    r = html_text._Random(3)
    for _ in range(20):
        order = html_text.nodes_of(html_text.build_tree(html_text.training_page(r)))
        odds = [r.uniform(-3, 3) for _ in order]
        html_text.decode(order, odds)
        assert all(n.parent.keep for n in order if n.keep and n.parent is not None)


def test_decoding_is_the_best_of_all():
    """Of all choices without a kept node below a dropped one, the decoding has the greatest likelihood."""
    import itertools

    r = html_text._Random(11)
    for _ in range(40):
        root = html_text.Node("#root", None)
        nodes = [root]
        for _ in range(r.randint(1, 9)):
            nodes.append(html_text.Node("div", r.choice(nodes)))
        order = html_text.nodes_of(root)
        odds = [r.uniform(-3, 3) for _ in order]
        value = lambda keep: sum(-np.log1p(np.exp(-o)) if k else -np.log1p(np.exp(o)) for k, o in zip(keep, odds))
        place = {id(n): k for k, n in enumerate(order)}
        choices = (c for c in itertools.product((False, True), repeat=len(order)) if c[0] and all(not k or n.parent is None or c[place[id(n.parent)]] for k, n in zip(c, order)))
        best = max(map(value, choices))
        html_text.decode(order, odds)
        assert np.isclose(value([n.keep for n in order]), best)


def test_attribute_words_in_any_case():
    tokens = lambda v: [t.lower() for t in html_text.SPLIT.split(v) if t]
    assert tokens("Sidebar") == ["sidebar"] and tokens("articleBody") == ["article", "body"] and tokens("NAV main_col2") == ["nav", "main", "col"]
    order = html_text.nodes_of(html_text.build_tree("<div class='Sidebar'>a</div><div ID=NAV>b</div><div itemprop=articleBody>c</div>"))
    assert [(n.aside, n.article) for n in order if n.tag == "div"] == [(1, 0), (1, 0), (0, 2)]


def test_pages_query_against_plain_steps(spark, page_model):
    """The distributed extraction equals the model applied to each page alone, whatever the cut of the table."""
    r = html_text._Random(77)
    rows = [(k, f"u{k}", html_text.training_page(r).replace(' k="1"', "")) for k in range(40)] + [(40, "u", "<p>" + "word " * 200000), (41, None, "<div>" * 30000 + "deep")]
    got = {x.page_id: x.text for x in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), page_model).collect()}
    assert got == {k: page_model.extract([h])[0] for k, _, h in rows}


def test_tree_and_blocks():
    page = "<body>a &amp; b<p>one<b> two<br>three</b><p>four <a href=x>link</a> \n five<ul><li>x<li>y</ul><script>var p='<p>no</p>';</script><!-- no <p> --><style>p{}</style>tail &#233;&copy"
    order = html_text.nodes_of(html_text.build_tree(page))
    assert [n.text for n in order if n.tag == "#text"] == ["a & b", "one two three", "four link five", "x", "y", "tail é©"]
    assert html_text.nodes_of(html_text.build_tree("<div>" * 5000 + "deep"))[-1].text == "deep"


def test_deep_nesting_closes_what_it_opened():
    page = "<div><article><p>first</p>" + "<div>" * 300 + "deep" + "</div>" * 300 + "<p>second</p></article></div><p>after</p>"
    leaves = {n.text: n for n in html_text.nodes_of(html_text.build_tree(page)) if n.tag == "#text"}
    up = lambda n: [] if n.parent is None else [n.parent.tag, *up(n.parent)]
    assert up(leaves["first"]) == up(leaves["second"]) == ["p", "article", "div", "#root"] and up(leaves["after"]) == ["p", "#root"]
    assert up(leaves["deep"])[:-1] == ["div"] * 300 + ["article", "div"]
    many = html_text.nodes_of(html_text.build_tree("<article>" + "<div>" * 50000 + "deep" + "</b></div></x>" * 50000 + "<p>end"))
    assert [n.text for n in many if n.tag == "#text"] == ["deep", "end"] and many[-1].parent.parent.tag == "article"


def test_head_without_end_tag():
    texts = lambda page: [n.text for n in html_text.nodes_of(html_text.build_tree(page)) if n.tag == "#text"]
    inner = "<meta charset=utf-8><title>no <p></title><script>var p='<p>no</p>';</script><style>p{}</style><link rel=x>"
    assert texts(f"<html><head>{inner}<p>one<p>two") == ["one", "two"]
    assert texts(f"<head>{inner}text first<div>two</div>") == ["text first", "two"]
    for page in (f"<head>{inner}</head><body><p>one", f"<head>{inner}<body><p>one", "<head><title>no</head><body><p>one", "<head><title>no<body><p>one"):
        assert texts(page) == ["one"]


def test_extract_pages(spark, page_model):
    body = "<nav class=menu><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>"
    article = "".join(f"<p>{prose(k, 50)}.</p>" for k in range(4))
    page = f"<html><head><title>t</title></head><body>{body}<article><h1>Title here</h1>{article}</article><footer>&copy; 2020 us</footer></body></html>"
    rows = [(1, "u1", page, 1), (2, None, None, 1), (3, "u3", "", 1), (4, "u4", page[:-200], 1), (5, "u5", body, 1), (1, "u1", page, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract_pages(table, page_model).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].text == "\n\n".join(["Title here", *(prose(k, 50) + "." for k in range(4))])
    assert by[2].text == by[3].text == "" and by[2].url is None and by[4].text.startswith("Title here\n\n")
    assert html_text.extract_pages(table.where("page_id > 9"), page_model).count() == 0

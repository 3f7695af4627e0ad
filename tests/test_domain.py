import json
import re

import pytest
from pyspark.sql import functions as F

from narrative_spark import rules
from narrative_spark.functions import model
from narrative_spark.operators import aliases, cards, logs, names, persona, validate
from narrative_spark.plans import flows
from narrative_spark.plans import queries as Q


def test_rank_and_contexts(spark):
    rows = [("b", c, 0, p, n) for c, ns in enumerate((["甲", "乙"], ["甲", "丙"], ["乙", "丙"], ["丙"])) for p, n in enumerate(ns)] + [("b", 0, 1, 0, "乙")]
    found = spark.createDataFrame(rows, "book_id string, chapter_index int, chunk_no int, pos int, name string")
    got = [tuple(r)[1:5] for r in names.rank(found, 3).select("book_id", "name", "chapter_count", "mentions", "rank").orderBy("rank").collect()]
    assert got == [("丙", 3, 3, 1), ("乙", 2, 3, 2), ("甲", 2, 2, 3)]
    chapters = spark.createDataFrame([("b", 1, "t", "甲后来走了。无关的话。"), ("b", 0, "t", "甲来了！甲又来了一次？短。甲")], "book_id string, chapter_index int, title string, content string")
    said = names.contexts(found.where("name = '甲'"), chapters, 3).orderBy("k").collect()
    assert [r.sentence for r in said] == ["甲来了！", "甲又来了一次？", "甲后来走了。"]


def test_cache_runs_twice(spark):
    chapters = spark.createDataFrame([("b", k, f"t{k}", f"文{k}" * 9) for k in range(5)], "book_id string, chapter_index int, title string, content string")
    first = names.with_fingerprint(chapters)
    cache = first.select(*names.KEY)
    assert names.cache_misses(first, cache).count() == 0 and names.cache_misses(first, cache, force=True).count() == 5
    edited = names.with_fingerprint(chapters.withColumn("content", F.when(F.col("chapter_index") == 2, F.lit("新")).otherwise(F.col("content"))))
    assert [r.chapter_index for r in names.cache_misses(edited, cache).collect()] == [2]


def told(spark, *texts):
    return spark.createDataFrame([("b", k, t) for k, t in enumerate(texts)], "book_id string, chapter_index int, text string")


def called(spark, *listed, book="b"):
    return spark.createDataFrame([(book, k, n) for k, n in enumerate(listed)], "book_id string, pos int, name string")


def test_evidence_needs_adjacent_names(spark):
    known = called(spark, "顾南舟", "南舟", "白榆", "贺兰", "贺兰霜", "阿霜")
    none = ["顾南舟一直怕的就是白榆", "白榆念完那两个字就找贺兰", "他就是白榆", "顾南舟就是白榆这把伞", "贺兰即是他", "顾南舟即是顾南舟"]
    assert aliases.marker_matches(told(spark, *none), known).count() == 0
    got = aliases.marker_matches(told(spark, "城里的贺兰霜，小名阿霜。她走了。", "无", "那顾南舟便是白榆，不是别人，正是贺兰霜。"), known).orderBy("seq").collect()
    assert {(r.tier, r.left, r.right, r.marker, r.seq >> 32) for r in got} == {("forced", "贺兰霜", "阿霜", "小名", 0), ("hint", "顾南舟", "白榆", "便是", 2), ("forced", "白榆", "贺兰霜", "不是别人，正是", 2)}
    assert got[0].context == "城里的贺兰霜，小名阿霜。她走了。"


def loop_matches(text, known):
    """The adjacency rule as plain loops over every place of every mark."""
    import re

    white = re.sub(r"\\s", "\\\\s", rules.MARK_BETWEEN)
    out = []
    for tier, markers, between in (("forced", rules.STRONG_MARKERS, rules.MARK_BETWEEN), ("hint", rules.WEAK_MARKERS, rules.WEAK_BETWEEN)):
        word = rules.NAME_CHARACTER + "{2,8}"
        for m in re.finditer(f"({word}){white}({'|'.join(markers)}){between}({word})", text):
            ends, begins = [n for n in known if text[: m.end(1)].endswith(n)], [n for n in known if text[m.start(3) :].startswith(n)]
            if ends and begins:
                left, right = max(ends, key=len), max(begins, key=len)
                rest = text[m.start(3) + len(right) :]
                if left != right and right not in rules.NOT_NAMES and right[0] not in rules.NOT_NAME_STARTS and not (rest and rest[0] in rules.NOT_AFTER_NAME):
                    out.append((tier, m.start(), left, right, m[2]))
    return out


def test_evidence_against_plain_loops(spark):
    import random

    r, names_ = random.Random(4), ["甲乙", "乙", "丙丁戊", "丁戊", "己庚", "他"]
    parts = [*names_, *names_, "，", "。", "\n", " ", "这", "即是", "就是", "小名", "叫做", "也", "其", "了"]
    texts = ["".join(r.choice(parts) for _ in range(120)) for _ in range(40)]
    got = aliases.marker_matches(told(spark, *texts), called(spark, *names_)).collect()
    want = [(tier, (k << 32) + at, a, b, m) for k, t in enumerate(texts) for tier, at, a, b, m in loop_matches(t, names_)]
    assert len(want) > 50 and sorted((x.tier, x.seq, x.left, x.right, x.marker) for x in got) == sorted(want)


def test_forbidden_beats_forced(spark):
    texts, known = told(spark, "白榆的妹妹名叫白棠。", "白榆即是白棠。"), called(spark, "白榆", "白棠")
    forbidden = aliases.forbidden_pairs(aliases.family_relations(texts), known)
    assert [tuple(r)[1:3] for r in forbidden.collect()] == [tuple(sorted(("白棠", "白榆")))]
    assert aliases.evidence(aliases.marker_matches(texts, known), forbidden).count() == 0


def test_passed_over_matches_do_not_count(spark):
    one = "白榆的妹妹名叫白棠。" + "白榆即是白棠。" * 201 + "贺兰即是贺兰霜。" + "贺兰就是贺兰霜。" * 201 + "顾南舟就是阿霜。"
    two = "贺兰即是贺兰霜。" * 199 + "顾南舟就是阿霜。陆沉就是阿霜。"
    texts = spark.createDataFrame([("b", one), ("c", two)], "book_id string, text string")
    listed = ["白榆", "白棠", "贺兰", "贺兰霜", "顾南舟", "阿霜", "陆沉"]
    known = called(spark, *listed).unionByName(called(spark, *listed, book="c"))
    forbidden = aliases.forbidden_pairs(aliases.family_relations(texts), known)
    got = aliases.evidence(aliases.marker_matches(texts, known), forbidden).collect()
    # forbidden pairs and hints that are forced leave the cap alone; both tiers share it
    assert {(r.book_id, frozenset((r.a, r.b)), r.tier) for r in got} == {(b, frozenset(p), t) for b in "bc" for p, t in ((("贺兰", "贺兰霜"), "forced"), (("顾南舟", "阿霜"), "hint"))}
    assert all(r.proof.endswith("（标记：即是）") for r in got if r.tier == "forced")


def test_all_pairs_count_without_a_cap(spark):
    text = "白榆的妹妹名叫白棠。" * 201 + "顾南舟的妹妹名叫阿霜。" + "贺兰即是贺兰霜。" * 201 + "顾南舟就是白榆。顾南舟即是阿霜。陆沉就是阿霜。"
    texts, known = told(spark, text), called(spark, "白榆", "白棠", "贺兰", "贺兰霜", "顾南舟", "阿霜", "陆沉")
    relations = aliases.family_relations(texts)
    assert aliases.forbidden_pairs(relations, known, rules.MOST_PAIRS).count() == 1
    forbidden = aliases.forbidden_pairs(relations, known)
    assert {frozenset((r.a, r.b)) for r in forbidden.collect()} == {frozenset(("白榆", "白棠")), frozenset(("顾南舟", "阿霜"))}
    got = {frozenset((r.a, r.b)): (r.tier, r.seq) for r in aliases.evidence(aliases.marker_matches(texts, known), forbidden, None).collect()}
    assert got == {frozenset(("贺兰", "贺兰霜")): ("forced", 1), frozenset(("顾南舟", "白榆")): ("hint", 202), frozenset(("陆沉", "阿霜")): ("hint", 203)}
    assert "k <= 200" not in Q.ORACLES["q20_same_person_evidence"]


def test_windows_find_what_a_whole_search_finds():
    import random

    r = random.Random(6)
    parts = ["甲乙", "丙", "丁戊己", "x", "，", "。", "\n", "\u3000", "其", "父親", "大兒子", "名叫", "就是", "本是同一人", "不是別人，正是", "即是", "小名"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(60)) + " " * 30 + "".join(r.choice(parts[:9]) for _ in range(40)) + "".join(r.choice(parts) for _ in range(40))
        clauses = [(no * 256 + k, m[1], m[2], m[4]) for no, c in enumerate(re.split(rules.CLAUSE_END, text)) for k, m in enumerate(aliases._RELATIVES.finditer(c))]
        assert aliases._relatives(text) == clauses
        whole = [(tier, m.start(), m[3]) for tier, _, pattern, _ in aliases._TIERS for m in pattern.finditer(text)]
        assert [(tier, at, marker) for tier, at, _, _, marker, _ in aliases._occurrences(text)] == whole
    # a text without the words is never searched by a pattern
    assert aliases.scan.windows("x" * 1000, rules.KINSHIP, lambda _, k: k, lambda _, k: k) == []


def test_candidates_whose_first_sentences_only_begin_like_them(spark, tmp_path):
    rows = [(k, "s", "en", t) for k, t in enumerate(["Marka Marka. Markab. Markac. Markad. Mark.", "Mark Marka", "Mark"])]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # Mark, Marka, Markab, Markac and Markad: each ends a sentence, though Mark stands in four others before
    assert [tuple(x) for x in Q.q67_candidates_with_contexts(spark, str(tmp_path)).collect()] == [("s", 5, 0)]


def test_components(spark):
    edges = spark.createDataFrame([("b", f"n{k:02}", f"n{k + 1:02}") for k in range(20)] + [("b", "長長的名字", "n00"), ("c", "x", "y")], "book_id string, a string, b string")
    roots = {r.name: r.root for r in aliases.components(edges).collect()}
    assert len(set(roots.values())) == 2 and len(roots) == 24
    got = aliases.groups(edges).collect()
    assert {r.main for r in got} == {"長長的名字", "x"} and len(got) == 22
    with pytest.raises(RuntimeError, match="didn't settle"):
        aliases.components(edges, rounds=1)


def merged(spark, groups, proofs, pool):
    rows = spark.createDataFrame([("b", k, m, a) for k, (m, names_) in enumerate(groups) for a in names_], "book_id string, pos int, main string, alias string")
    pairs = spark.createDataFrame([("b", *sorted(p), k) for k, p in enumerate(proofs)], "book_id string, a string, b string, seq int")
    out = {}
    for r in aliases.merge_groups(rows, pairs, called(spark, *pool)).collect():
        out.setdefault(r.main, set()).add(r.alias)
    return out


def test_groups_follow_their_proofs(spark):
    assert merged(spark, [("甲一", ["甲"])], [], ["甲一", "一"]) == {"甲一": {"甲"}}  # no proof, nothing is touched
    assert merged(spark, [], [("丙", "乙")], []) == {"丙": {"乙"}}  # two outsiders: the smaller name leads
    assert merged(spark, [("短", ["x"]), ("很長的", ["y"])], [("x", "y")], []) == {"很長的": {"短", "x", "y"}}  # two groups: the wider name
    assert merged(spark, [("ab", ["x"]), ("cd", ["y"])], [("y", "x")], []) == {"ab": {"cd", "x", "y"}}  # as wide: that of the smaller of the pair
    assert merged(spark, [("短", ["x"])], [("x", "非常非常長")], []) == {"短": {"x", "非常非常長"}}  # an outsider follows the group's name
    assert merged(spark, [("兰霜", ["小兰"]), ("贺兰霜", ["阿霜"])], [("p", "q")], ["霜", "贺兰霜", "兰霜"]) == {"贺兰霜": {"兰霜", "小兰", "阿霜", "霜"}, "p": {"q"}}


def test_guard_takes_aliases_out(spark):
    grouped = spark.createDataFrame([("b", "甲", "乙"), ("b", "甲", "丙"), ("b", "丁", "戊")], "book_id string, main string, alias string")
    barred = spark.createDataFrame([("b", *sorted(("甲", "乙"))), ("b", *sorted(("丁", "戊")))], "book_id string, a string, b string")
    assert [tuple(r)[1:] for r in aliases.guard(grouped, barred).collect()] == [("甲", "丙")]


def test_source_forms(spark):
    texts = spark.createDataFrame([("b", 0, "趙風來時"), ("b", 1, "书在东边")], "book_id string, chapter_index int, content string")
    listed = spark.createDataFrame([("b", n) for n in ("赵风", "書", "不在", "来时", "东")], "book_id string, name string")
    forms = names.source_forms(listed, texts)
    assert {r.name: r.form for r in forms.collect()} == {"赵风": "趙風", "書": "书", "不在": "不在", "来时": "來時", "东": "东"}
    assert {r.name for r in names.renamed(forms).collect()} == {"赵风", "書", "来时"}


OBS = "book_id string, character string, chapter_index int, field_no int, field string, value string"


def test_change_log(spark):
    rows = [("b", "c", k, 0, "personality", v) for k, v in enumerate(("冷", "冷", "暖", "冷"))] + [("b", "c", 1, 1, "desire", "活")]
    found = spark.createDataFrame(rows, OBS)
    log = persona.change_log(found)
    assert [(r.chapter_index, r.value, r.previous) for r in log.where("field = 'personality'").orderBy("chapter_index").collect()] == [(0, "冷", None), (2, "暖", "冷"), (3, "冷", "暖")]
    now = persona.current(found).first()
    assert (now.personality, now.desire, now.flaw) == ("冷", "活", "")
    texts = {r.field: r.text for r in persona.evolution(log).collect()}
    assert texts == {"personality": "冷", "desire": "活"}
    assert persona.timeline_events(log, 2).count() == 2
    assert [r.reason for r in persona.conflicts(log).orderBy("chapter_index").collect()] == [rules.CONFLICT_REASON % k for k in (2, 3)]
    assert [r.known for r in persona.running(found).where("field = 'personality'").orderBy("chapter_index").collect()] == [None, "冷", "冷", "暖"]


def test_facts_and_empty(spark):
    schema = "book_id string, character string, chapter_index int, personality string, desire string, flaw string, secret string, speech_style string, relationships array<struct<target:string,change:string>>"
    rows = spark.createDataFrame([("b", "c", 0, "\u3000冷 \n", "\u3000\n", None, "s", "", []), ("b", "c", 1, "", "", "", "", "", []), ("b", "c", 2, "", "", "", "", "", [("x", "y")])], schema)
    assert [(r.field, r.value) for r in persona.facts(rows).orderBy("field_no").collect()] == [("personality", "冷"), ("secret", "s")]
    assert [r[0] for r in rows.orderBy("chapter_index").select(persona.is_empty()).collect()] == [False, True, False]


def test_quotes_are_tagged_once(spark):
    q = spark.createDataFrame([("b", "c", 0, 0, "desire", "t"), ("b", "c", 2, 0, "desire@ch2", "t"), ("b", "c", 3, 0, "flaw", "u")], "book_id string, character string, chapter_index int, pos int, field string, text string")
    assert sorted((r.field, r.text) for r in persona.tagged_quotes(q).collect()) == [("desire", "t"), ("flaw@ch3", "u")]


def test_relations_and_summary(spark):
    rows = spark.createDataFrame([("b", "c", k, f"t{k % 2}", "变" * (50 if k == 19 else 3) + str(k)) for k in range(20)] + [("b", "c", 30, "", "")], "book_id string, character string, seq int, target string, change string")
    got = {r.target: r for r in persona.relation_rows(rows).collect()}
    assert set(got) == {"t0", "t1"} and got["t0"].description == "变变变18" and len(got["t1"].evolution) == 10
    s = persona.recent_summary(rows).first()
    assert s.omitted == 8 and len(s.summary.split("\n")) == 13 and s.summary.split("\n")[-2].endswith("…") and s.summary.endswith("8 条较早的关系变化已省略）")
    now = spark.createDataFrame([("b", "c", "静", "", None, "", "慢"), ("b", "d", "", "", "", "", "")], "book_id string, character string, personality string, desire string, flaw string, secret string, speech_style string")
    changes = spark.createDataFrame([("b", "c", k, "flaw", f"f{k}", f"t{k}") for k in range(7)], "book_id string, character string, pos int, field string, `from` string, `to` string")
    known = flows._Known()
    known.fields = {"personality": "静", "speech_style": "慢"}
    known.relations = [(r.target, r.change) for r in rows.where("target <> ''").orderBy("seq").collect()]
    known.changes = [(r["field"], r["from"], r["to"]) for r in changes.orderBy("pos").collect()]
    whole = {r.character: r.summary for r in persona.summary(now, rows, changes).collect()}
    assert whole == {"c": known.text()} and len(known.text().split("\n")) == 2 + 12 + 1 + 5 and flows._Known().text() == rules.SUMMARY_EMPTY


FIELDS = "book_id string, character string, chapter_index int, field string, text string"


def test_validation_outcomes(spark):
    chapters = spark.createDataFrame([("b", 0, "雨停了，顾南舟 收起伞。")], "book_id string, chapter_index int, content string")
    at = ("b", "c", 0)
    quotes = spark.createDataFrame([(*at, "personality", "「顾南舟收起伞」"), (*at, "desire@ch3", "没有的话"), (*at, "flaw", "。。"), ("b", "c", 9, "flaw", "不在的章")], FIELDS)
    found = spark.createDataFrame([(*at, 0, f, v) for f, v in (("personality", "性格复杂" + "冷" * 20), ("desire", "想要一直走到海边为止吧"), ("flaw", "x"), ("secret", "没有依据的一个秘密在此"))], OBS)
    got = {r.field: r.outcome for r in validate.field_outcomes(found, validate.ground_quotes(quotes, chapters)).collect()}
    assert got == {"personality": "ok", "desire": "ungrounded", "flaw": "ungrounded", "secret": "cleared"}
    relations = spark.createDataFrame([(*at, "白榆", "她深不可测"), (*at, "贺兰", "如常")], "book_id string, character string, chapter_index int, target string, change string")
    for strict in (False, True):
        kept, findings = validate.validate(found, quotes, chapters, strict, relations)
        assert sorted(r.field for r in kept.collect()) == (["personality"] if strict else ["desire", "flaw", "personality"])
        by_rule = {}
        for r in findings.collect():
            by_rule.setdefault(r.rule, []).append(r.item)
        assert sorted(by_rule["cliche"]) == sorted(["personality: 命中套话「性格复杂」", "relationships[白榆]: 命中套话「深不可测」"])
        assert by_rule["length"] == ["flaw: 1 字（要求 10–25）"] and sorted(by_rule["quote"]) == sorted(["desire@ch3: 没有的话", "flaw: 。。", "flaw: 不在的章"])
        assert sorted(by_rule["cleared"]) == (["desire", "flaw", "secret"] if strict else ["secret"])
    assert validate.merged_findings(findings.union(findings)).count() == findings.select("rule", "item").distinct().count()
    texts = validate.checked(found, quotes, chapters).where("part = 'quote'").collect()
    assert [(r.field, r.value) for r in texts] == [("personality", "「顾南舟收起伞」")]


def test_the_reply_rules_are_those_of_tables(spark):
    """What an extraction does to each reply is what the rules do to tables."""
    import random

    r, source = random.Random(2), "顾南舟在雨里站了很久，没有回头。白榆说：走吧。"
    schema = "book_id string, character string, chapter_index int, pos int, field string, text string"
    for _ in range(6):
        one = {f: r.choice(("", "x", "神秘莫测的样子在这里十分明显", "稳" * 30)) for f in rules.FIELDS}
        one["quotes"] = [{"field": r.choice(rules.FIELDS) + r.choice(("", "@ch2")), "text": r.choice(("雨里，站了很久", "没有的句子", "", "白榆说走吧")), "confidence": ""} for _ in range(3)]
        one["relationships"] = [{"target": "t", "change": r.choice(("多面的人", "友"))}]
        quotes = spark.createDataFrame([("b", "c", 0, k, q["field"], q["text"]) for k, q in enumerate(one["quotes"])], schema)
        found = spark.createDataFrame([("b", "c", 0, k, f, one[f]) for k, f in enumerate(rules.FIELDS) if one[f]] or [("b", "c", 0, 0, "none", "")], OBS).where("value <> ''")
        told_ = spark.createDataFrame([("b", "c", 0, "t", one["relationships"][0]["change"])], "book_id string, character string, chapter_index int, target string, change string")
        chapters = spark.createDataFrame([("b", 0, source)], "book_id string, chapter_index int, content string")
        kept, findings = validate.validate(found, quotes, chapters, relations=told_)
        listed = flows._judged(one, flows._IGNORED.sub("", source))
        assert sorted(listed) == sorted((x.rule, x.item) for x in findings.collect())
        assert {x.field: x.value for x in kept.collect()} == {f: one[f] for f in rules.FIELDS if one[f]}


PERSONA = "book_id string, character string, personality string, desire string, flaw string, secret string, speech_style string"


def test_cards(spark):
    made = cards.build(spark.createDataFrame([("书", "甲", "冷", "活", "", "", "")], PERSONA), "novel")
    card = made.first()
    assert card.description == "性格：冷\n欲望：活\n来源：《书》" and card.tags == ["novel"] and card.scenario == "" and card.source_book == "书"
    data = json.loads(cards.to_json(made).first().json)
    assert data["spec"] == "chara_card_v2" and data["data"]["extensions"]["narrative"]["desire"] == "活" and data["data"]["character_book"] == {"entries": []}
    found = {(r.rule, r.item) for r in validate.card_findings(made).collect()}
    assert found == {("empty", "flaw"), ("empty", "secret"), ("empty", "speech_style"), ("unquoted", "personality"), ("unquoted", "desire")}


def card_rules(spark, **over):
    base = {"name": "n", "description": "d", "personality": "p", "first_mes": "", "mes_example": ""} | {f: "x" for f in cards.STRUCTURED}
    row = base | over
    quotes = spark.createDataFrame([("n", f"{f}@ch2") for f in rules.FIELDS], "name string, field string")
    table = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return {(r.rule, r.item) for r in validate.card_findings(table, quotes).collect()}, validate.card_ok(validate.card_findings(table, quotes), table).first().ok


def test_card_findings(spark):
    assert card_rules(spark) == (set(), True)
    assert card_rules(spark, personality=" \u3000") == ({("missing", "personality")}, False)  # blanks are nothing
    assert card_rules(spark, description="") == ({("missing", "description")}, False)
    assert card_rules(spark, secret="\n") == ({("empty", "secret")}, True)
    assert card_rules(spark, mes_example="<START> {{user}}: hi")[0] == set()  # one placeholder is enough
    assert card_rules(spark, mes_example="hi")[0] == {("marker", "<START>"), ("placeholder", "{{user}} / {{char}}")}
    assert card_rules(spark, first_mes="y" * 19)[0] == {("length", "first_mes: 19")} and card_rules(spark, first_mes="y" * 20)[0] == set()


def test_card_keeps_all_it_came_with(spark):
    """A foreign card with everything in it, imported, exported and imported again."""
    lore = [{"keys": ["k", "l"], "content": "c", "enabled": False, "insertion_order": 4, "case_sensitive": True, "position": "after", "id": 9, "extensions": {"a": None}}, {"key": "solo", "content": 5}]
    own = {
        "desire": "w", "timeline": [{"id": "t0", "order": 0, "summary": "s", "actors": ["x"], "chapter": None, "quote": "q"}, "junk"], "relations": [{"from": "n", "to": "m", "evolution": ["a", "b"]}],
        "plot_nodes": [{"id": "p", "title": "T"}], "source_book": "书", "extraction_meta": {"quotes": [{"field": "desire", "text": "t"}], "other": {"deep": [1, None]}},
    }
    raw = {"spec": "chara_card_v3", "data": {"name": "n", "description": None, "tags": "one", "character_book": {"entries": lore}, "character_version": "", "extensions": {"narrative": own, "foreign": 1}}}
    table = lambda j: spark.createDataFrame([(1, j)], "id int, json string")
    one = cards.import_cards(table(json.dumps(raw)))
    c = one.first()
    assert (c.name, c.description, c.tags, c.character_version, c.desire, c.source_book) == ("n", "", ["one"], "1.0", "w", "书")
    assert [tuple(x) for x in c.character_book] == [(["k", "l"], "c", False, 4, True), (["solo"], "5", True, 0, False)] and [json.loads(x) for x in c.lore] == [{"position": "after", "id": 9, "extensions": {"a": None}}, {}]
    assert [tuple(x) for x in c.timeline] == [("t0", 0, "s", ["x"], None, "q")] and [tuple(x) for x in c.relations] == [("n", "m", "", "", ["a", "b"])] and c.plot_nodes[0].branch == "canon"
    out = json.loads(cards.to_json(one).first().json)["data"]
    assert out["character_book"]["entries"][0]["position"] == "after" and out["character_book"]["entries"][0]["keys"] == ["k", "l"] and "position" not in out["character_book"]["entries"][1]
    kept = out["extensions"]["narrative"]
    assert kept["extraction_meta"] == own["extraction_meta"] and kept["timeline"][0]["chapter"] is None and kept["lore"][0]["id"] == 9 and kept["source_book"] == "书"
    again = cards.import_cards(table(cards.to_json(one).first().json)).first()
    assert again.asDict(True) == c.asDict(True) | {"extraction_meta": again.extraction_meta} and json.loads(again.extraction_meta) == json.loads(c.extraction_meta)


def test_coercions(spark):
    rows = ["null", '"x"', "5", "2.7", "true", "false", "[1, null, \"b\"]", "{}", '" yes "', '" 12 "', '"3.5"', "0"]
    table = spark.createDataFrame(list(enumerate(rows)), "k int, j string").select("k", F.try_parse_json("j").alias("v")).union(spark.sql("select 99, cast(null as variant)"))
    got = table.orderBy("k").select(cards.as_text(F.col("v")), cards.as_list(F.col("v")), cards.as_bool(F.col("v"), True), cards.as_int(F.col("v"), 7)).collect()
    assert [r[0] for r in got] == ["", "x", "5", "2.7", "True", "False", '[1,null,"b"]', "{}", " yes ", " 12 ", "3.5", "0", ""]
    assert [r[1] for r in got][:7] == [[], ["x"], ["5"], ["2.7"], ["True"], ["False"], ["1", "", "b"]]
    assert [r[2] for r in got] == [True, False, True, True, True, False, True, True, True, False, False, False, True]
    assert [r[3] for r in got] == [7, 7, 5, 2, 1, 0, 7, 7, 7, 12, 7, 0, 7]


def test_logs(spark):
    rows = spark.createDataFrame([("c", "m1", k, v) for k, v in enumerate(("a", "a", "b"))] + [("c", "m2", 9, "z")], "character_id string, id string, seq int, content string")
    got = {r.id: (r.content, r.first_seq, r.writes) for r in logs.memory(rows).collect()}
    assert got == {"m1": ("b", 0, 2), "m2": ("z", 9, 1)}
    touched = spark.createDataFrame([("c", "m1"), ("c", "m1"), ("c", "nobody")], "character_id string, id string")
    assert {r.id: r.hits for r in logs.hits(logs.memory(rows), touched).collect()} == {"m1": 2, "m2": 0}
    events = spark.createDataFrame([("s", 0, "meta", "x", None), ("s", 2, "message", None, "hi"), ("s", 1, "message", "y", "yo")], "session_id string, seq int, kind string, state string, message string")
    s = logs.sessions(events).first()
    assert (s.state, s.n_messages, s.messages) == ("y", 2, ["yo", "hi"])


def test_model_calls_are_retried(spark):
    slept, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return {"content": "[]", "prompt_tokens": 7}

    got = model.call_with_retry(flaky, "p", sleep=slept.append)
    assert got["ok"] and got["attempts"] == 3 and slept == [1.0, 2.0] and got["prompt_tokens"] == 7
    calls.clear()
    failed = model.call_with_retry(lambda p: 1 / 0, "p", retries=1, sleep=slept.append)
    assert not failed["ok"] and failed["error"].startswith("ZeroDivisionError")


def test_memory_entries(spark):
    rows = spark.createDataFrame([("c", "", "a"), ("c", None, "a"), ("c", "given", "b")], "character_id string, id string, content string")
    got = [r.id for r in logs.entries(rows).collect()]
    assert got[0] == got[1] and got[0].startswith("mem_") and got[2] == "given"
    with pytest.raises(Exception, match="without a character"):
        logs.entries(spark.createDataFrame([("", "x", "a")], "character_id string, id string, content string")).collect()


def test_json_is_one_value(spark):
    rows = spark.createDataFrame(list(enumerate(['{"a": 1}', "[1]", "[1]]", '{"a": 1}}', "1, 2", "", "x", " [2] ", None])), "k int, j string")
    assert [r[0] for r in rows.orderBy("k").select(F.to_json(model.parsed("j"))).collect()] == ['{"a":1}', "[1]", None, None, None, None, None, "[2]", None]


def test_replies(spark):
    rows = spark.createDataFrame([(1, '```json\n{"groups": [{"main": "甲", "aliases": ["甲", "乙", "乙"]}, {"main": "", "aliases": ["x"]}]}\n```'), (2, "bad"), (3, '{"personality": "冷", "relationships": {"target": "乙", "change": "友"}, "speech_samples": "哦", "extra": 1}')], "id int, reply string")
    got = {r.id: r for r in rows.select("id", model.alias_groups_of("reply").alias("g"), model.persona_of("reply").alias("p")).collect()}
    assert [(g.main, g.aliases) for g in got[1].g] == [("甲", ["乙"])] and got[2].g == [] and got[2].p is None
    assert got[3].p.personality == "冷" and [tuple(x) for x in got[3].p.relationships] == [("乙", "友")] and got[3].p.speech_samples == ["哦"]


def test_queries_and_oracles_match_names():
    assert set(Q.ORACLES) <= set(Q.QUERIES)


def test_a_reply_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"personality": "冷"}',)], "reply string")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    # once to see that it is whole, once for its value
    for made in (model.persona_of("reply"), model.alias_groups_of("reply"), model.names_of("reply"), model.cached_tokens(F.col("reply"))):
        assert plan(made).count("try_parse_json") == 2


def test_the_schema_of_a_value_is_asked_once(spark):
    rows = spark.createDataFrame([('{"a": 1}',)], "j string").select(F.try_parse_json("j").alias("v"))
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    for made in (cards.as_text(F.col("v")), cards.as_int(F.col("v")), cards.as_bool(F.col("v"), True)):
        assert plan(made).count("schema_of_variant") == 1


def test_rounds_of_components_pass_no_labels_through_the_driver(spark, monkeypatch):
    plans, keep = [], aliases.kept
    monkeypatch.setattr(aliases, "kept", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    edges = spark.createDataFrame([("b", "x", "y"), ("b", "y", "z")], "book_id string, a string, b string")
    assert {r.root for r in aliases.components(edges).collect()} == {"x"}
    assert all(p.count("strategy=merge") == p.count("Join ") for p in plans) and "Join " in plans[2]


def test_decoding_bounds_its_batches(spark):
    from narrative_spark.sources import files

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files.decoded(spark.createDataFrame([("/a.txt", bytearray(b"x"))], "path string, content binary"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20


def test_quotes_are_matched_without_a_pattern(spark):
    from narrative_spark.functions import text as T

    every = "".join(chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000)
    rows = spark.createDataFrame([(every + "\U00020000",), (None,)], "t string").select(T.for_matching("t").alias("n"), F.regexp_replace(F.coalesce("t", F.lit("")), T.unicode_spaces(rules.IGNORED_IN_QUOTES), "").alias("want"))
    assert all(r.n == r.want for r in rows.collect())
    assert "regexp_replace" not in rows.select("n")._jdf.queryExecution().optimizedPlan().toString()

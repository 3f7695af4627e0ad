import json

import pytest
from pyspark.sql import functions as F

from narrative_spark.config import Settings
from narrative_spark.operators import cards
from narrative_spark.plans import flows, views


NAMES = ("贺兰霜", "阿霜", "顾南舟", "老顾")


def people(prompt):
    return {"content": json.dumps({"characters": [n for n in NAMES if n in prompt]}, ensure_ascii=False), "prompt_tokens": 1}


class Once:
    """A model that answers each prompt once: a plan that asks again fails."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer

    def __call__(self, prompt):
        import hashlib
        import os

        os.close(os.open(f"{self.folder}/{hashlib.sha1(prompt.encode()).hexdigest()}", os.O_CREAT | os.O_EXCL))
        return {"content": self.answer}


def describing(prompt):
    mood = "心里暖得像刚升起来的炉火一样的人" if "- 性格：" in prompt else "脸上冷得像腊月里结冰的河面一样的人"
    quotes = [{"field": "personality", "text": "贺兰霜 推开了门"}, {"field": "flaw", "text": "书里没有的话"}]
    return {"content": json.dumps({"personality": mood, "flaw": "说得太多而又做得太少了", "secret": "没有引文的秘密应当被清掉", "quotes": quotes, "relationships": {"target": "乙", "change": "友"}, "speech_samples": "嗯"}, ensure_ascii=False)}


def test_from_files_to_cards(spark, tmp_path):
    def stored(df):
        """Steps meet in tables, as they do in production: a plan then holds one step."""
        path = f"{tmp_path}/t{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    text = "第一章 甲\n贺兰霜推开了门。贺兰霜，小名阿霜。\n\n閒話。\n第二章 乙\n贺兰霜推开了门又关上。\n\n顾南舟的妻子名叫贺兰霜。\n第三章 丙\n無人。"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "book.txt").write_bytes(text.encode("gb18030"))
    books, chapters = flows.ingest(spark, str(tmp_path / "in"))
    chapters = stored(chapters)
    assert books.first().chapter_count == 3
    scanned = stored(flows.scan_chapters(chapters, people))
    assert [r.chunks for r in scanned.orderBy("chapter_index").collect()] == [[["贺兰霜", "阿霜"]], [["贺兰霜", "顾南舟"]], [[]]]

    def never(prompt):
        raise AssertionError("cached")

    again = flows.cached_scan(chapters, scanned, never, retries=0)
    assert again.count() == 3
    ranked = stored(flows.identify(chapters, scanned))
    assert ranked.orderBy("rank").first().name == "贺兰霜" and ranked.where("name = '贺兰霜'").first().contexts[0] == "贺兰霜推开了门。"
    (tmp_path / "asked").mkdir()
    grouping = Once(tmp_path / "asked", '{"groups": [{"main": "顾南舟", "aliases": ["贺兰霜"], "reason": "?"}]}')
    found = {(r.main, r.alias) for r in flows.merge_aliases(ranked, chapters, grouping, retries=0).collect()}
    assert found == {("顾南舟", "阿霜")}  # the proof joins what the model said; relatives are taken out, whatever it says
    who = spark.createDataFrame([("book", "贺兰霜", ["贺兰霜", "阿霜"])], "book_id string, character string, names array<string>")
    increments = stored(flows.extract(chapters, who, describing))
    rows = increments.orderBy("chapter_index").collect()
    assert [r.calls for r in rows] == [1, 1, 0] and [len(r.quotes) for r in rows] == [1, 1, 0] and rows[0].secret == "" and rows[0].flaw != ""
    assert {(f.rule, f.item) for f in rows[0].findings} == {("quote", "flaw: 书里没有的话"), ("cleared", "secret"), ("ungrounded", "flaw")}
    folded = flows.fold(increments)
    assert folded["persona"].first().personality.startswith("心里暖") and folded["log"].where("field = 'personality'").count() == 2 and folded["relations"].first().n == 2
    assert [r.field for r in folded["quotes"].collect()] == ["personality"] and folded["findings"].where("rule = 'cleared'").count() == 1
    # without the findings of an extraction, increments are held against their chapters
    plain = flows.fold(increments.drop("findings").withColumn("quotes", F.expr("array(named_struct('field', 'personality', 'text', '贺兰霜推开', 'confidence', ''), named_struct('field', 'flaw', 'text', '假的', 'confidence', ''))")), chapters)
    assert plain["facts"].where("field = 'personality'").count() == 2 and [r.text for r in plain["quotes"].collect()] == ["贺兰霜推开"]
    made, findings = flows.build(folded)
    card = made.first()
    assert [(r["from"], r["to"], r["description"], r["evolution"]) for r in card.relations] == [("贺兰霜", "乙", "友", ["友", "友"])] and [e.id for e in card.timeline] == ["t0", "t1", "t2"]
    meta = json.loads(card.extraction_meta)
    assert [q["field"] for q in meta["quotes"]] == ["personality"] and meta["speech_samples"] == ["嗯"] and len(meta["changes"]) == 1 and meta["book_id"] == "book"
    replies = Once(tmp_path / "asked", '```json\n{"first_mes": "你好", "mes_example": "<START>"}\n```')
    texts = flows.card_texts(made, folded["samples"], replies).first()
    assert (texts.first_mes, texts.mes_example) == ("你好", "<START>") and texts.description.startswith("性格：心里暖")
    assert {(r.rule, r.item) for r in findings.collect()} == {("unquoted", "flaw"), ("empty", "desire"), ("empty", "secret"), ("empty", "speech_style")}
    with pytest.raises(Exception, match="no readable reply in 2 tries"):
        flows.card_texts(made, folded["samples"], lambda p: {"content": "no json"}, retries=0).collect()
    shown = views.chapters(chapters, 2), views.candidates(ranked), views.samples(folded["samples"]), views.quotes(folded["quotes"]), views.timeline(folded["timeline"], 1), views.card(cards.counters(made), findings)
    assert [t.count() for t in shown] == [2, 3, 1, 1, 1, 1]


def test_unreadable_replies_count_as_failed(spark):
    chapters = spark.createDataFrame([("b", 0, "t", "x")], "book_id string, chapter_index int, title string, content string")
    row = flows.scan_chapters(chapters, lambda p: {"content": "no json"}, retries=0).first()
    assert row.chunks == [[]] and row.failed == 1


def test_chunk_shapes(spark):
    rows = spark.createDataFrame([(1, '["a", "b"]'), (2, '[["a"], []]'), (3, "[]"), (4, "bad")], "id int, parts string")
    assert [r[0] for r in rows.orderBy("id").select(flows.canonical_chunks(F.col("parts"))).collect()] == [[["a", "b"]], [["a"], []], [[]], [[]]]


def test_settings():
    env = {"NARRATIVE_TOP_N": "3", "NARRATIVE_MODEL": ""}.get
    assert Settings.load(env).top_n == 3 and Settings.load(env, top_n=9).top_n == 9 and Settings.load(env).model == ""


def test_keys(monkeypatch):
    with pytest.raises(RuntimeError, match="no key"):
        Settings.load(lambda _: None).require_key()
    settings = Settings.load({"NARRATIVE_API_KEY": " k "}.get)
    assert settings.require_key() == "k" and "k" not in repr(settings).split("Settings(")[1].replace("fallback", "").replace("book", "").split("top_n")[1]

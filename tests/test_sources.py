import json
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from narrative_spark.sources import files
from narrative_spark.sources.catalog import Catalog, export_documents, export_json
from narrative_spark.streaming import logs as streaming


@pytest.mark.parametrize(
    ("data", "encoding"),
    [
        (b"", "utf-8"), (b"plain ascii", "utf-8"), ("漢字".encode(), "utf-8"), (b"\xef\xbb\xbfx", "utf-8-sig"), (b"\xff\xfe" + "字".encode("utf-16-le"), "utf-16-le"),
        (b"\xfe\xff" + "字".encode("utf-16-be"), "utf-16-be"), ("船到了對岸".encode("gb18030"), "gb18030"), ("plain latin text".encode("utf-16-le"), "utf-16-le"),
    ],
)
def test_detect(data, encoding):
    assert files.detect(data)[0] == encoding


@given(st.binary(max_size=60))
def test_decode_never_fails(data):
    assert isinstance(files.decode(data)[0], str)


def test_read_books(spark, tmp_path):
    text = "第二回\n船到了對岸。\n翻页"
    (tmp_path / "《名》.txt").write_bytes(text.encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"\xfe\xff" + text.encode("utf-16-be"))
    (tmp_path / "c.txt").write_bytes(text.encode())
    got = {r.book_id: r for r in files.read_books(spark, str(tmp_path)).collect()}
    assert set(got) == {"名", "b", "c"} and {r.text for r in got.values()} == {"第二回\n船到了對岸。"} and got["c"].char_count == 10


def test_json_lines_skip_damage(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n[1]\n{"a": 2, "z": 3}\n')
    assert sorted(r.a for r in files.read_json_lines(spark, str(tmp_path), "a int").collect()) == [1, 2]
    (tmp_path / "y.json").write_text("{")
    assert [r.value for r in files.read_json_documents(spark, str(tmp_path / "y.json")).collect()] == [None]


def test_templates(spark, tmp_path):
    (tmp_path / "names.md").write_text("<!-- about -->\n\nList {text} <!-- stays -->")
    found = files.read_templates(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("names", "List {text} <!-- stays -->")] and files.template(found, "names").startswith("List")
    with pytest.raises(KeyError, match="there are names"):
        files.template(found, "other")


def test_a_second_save_keeps_the_rest(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert c.load("chapters") is None and c.find("chapters", book_id="a") is None and not c.delete("chapters", book_id="a") and not c.exists("books", book_id="a")
    chapter = "book_id string, chapter_index int, title string, content string"
    c.save_novel(table([("a", "e1"), ("12", "e2")], "book_id string, encoding string"), table([("a", 0, "t", "x"), ("a", 1, "t", "y"), ("12", 0, "t", "z")], chapter))
    c.save_novel(table([("a", "e3")], "book_id string, encoding string"), table([("a", 0, "t", "new")], chapter))
    assert sorted((r.book_id, r.encoding) for r in c.load("books").collect()) == [("12", "e2"), ("a", "e3")]  # one row a book
    assert sorted((r.book_id, r.content) for r in c.load("chapters").collect()) == [("12", "z"), ("a", "new")]  # no chapter of the old novel
    assert [r.book_id for r in c.ids("chapters").collect()] == ["12", "a"] and c.load("chapters", book_id="12").first().content == "z"
    cache = "book_id string, chapter_index int, fingerprint string, chunks array<array<string>>"
    c.save("chapter_names", table([("a", k, "f", [["n"]]) for k in (2, 0, 1)], cache))
    c.save("chapter_names", table([("a", 1, "g", [["m"]]), ("a", 3, "f", None)], cache))
    assert [(r.chapter_index, r.fingerprint) for r in c.names("a").collect()] == [(0, "f"), (1, "g"), (2, "f")]  # in order, without what isn't a cache
    for who in ("p", "q", "p"):
        c.save("personas", table([("a", who, f"of {who}")], "book_id string, character string, personality string"))
    assert sorted(r.character for r in c.load("personas", book_id="a").collect()) == ["p", "q"]
    assert c.delete("personas", book_id="a", character="p") == 1 and [r.character for r in c.load("personas").collect()] == ["q"]
    c.save("personas", table([("a", "p", "back")], "book_id string, character string, personality string"))
    assert c.load("personas", character="p").first().personality == "back" and c.delete("personas", book_id="none") == 0
    files = len(list((tmp_path / "personas").rglob("*.parquet")))
    c.compact("personas")
    assert sorted(r.character for r in c.load("personas").collect()) == ["p", "q"] and len(list((tmp_path / "personas").rglob("*.parquet"))) < files


def test_cards_and_logs(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    for name, text in (("甲/乙", "one"), ("甲/乙", "two"), ("丙", "three")):
        c.save("cards", spark.createDataFrame([(name, text)], "name string, personality string"))
    assert sorted((r.card_id, r.personality) for r in c.load("cards").collect()) == [("丙", "three"), ("甲乙", "two")] and [r.card_id for r in c.ids("cards").collect()] == ["丙", "甲乙"]
    c.save("cards", spark.createDataFrame([("", "given", "x")], "name string, card_id string, personality string"))
    with pytest.raises(Exception, match="identifier is empty"):
        c.save("cards", spark.createDataFrame([("", "x")], "name string, personality string"))
    assert c.exists("cards", card_id="given") and c.delete("cards", card_id="given") == 1 and not c.exists("cards", card_id="given")
    for k in range(3):
        c.save("memory", spark.createDataFrame([("c", "m", k), ("d", "m", k)], "character_id string, id string, seq int"))
    assert c.load("memory").count() == 6 and c.delete("memory", character_id="c") == 3 and c.load("memory").count() == 3 and [r[0] for r in c.ids("memory").collect()] == ["d"]


def test_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("甲:乙", '{"b": 1, "a": "字"}')], "name string, json string")
    export_json(rows, str(tmp_path / "out"))
    export_json(rows, str(tmp_path / "out"), "append")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    export_documents(rows, str(tmp_path / "docs"))
    (file,) = (tmp_path / "docs" / "name=甲乙").glob("*.txt")
    text = file.read_text(encoding="utf-8")
    assert "字" in text and text.count("\n") > 2 and json.loads(text) == {"a": "字", "b": 1}


def test_name_caches(spark, tmp_path):
    for book, n, content in (("b", 1, '{"chapter_index": 1, "fingerprint": "f", "parts": [["x"], []]}'), ("b", 0, '{"chapter_index": 0, "parts": ["y"]}'), ("b", 2, "{broken"), ("书", 0, "[1]")):
        (tmp_path / book / "chapters").mkdir(parents=True, exist_ok=True)
        (tmp_path / book / "chapters" / f"{n}.names.json").write_text(content)
    got = [tuple(r) for r in files.read_name_caches(spark, str(tmp_path)).collect()]
    assert got == [("b", 0, "", [["y"]]), ("b", 1, "f", [["x"], []])]


def test_streams(spark, tmp_path):
    schema = "character_id string, id string, content string, ts timestamp, kind string"
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("c", "m", "a", t, "k"), ("c", "m", "a", t, "k"), ("c", "m", "b", t, "k")], schema).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = streaming.memory_stream(events, f"{tmp_path}/log", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.content for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["a", "b"]
    counts = streaming.event_counts(events).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert [r.n for r in spark.sql("select n from counts").collect()] == [3]

import pytest
from pyspark.sql import functions as F

from narrative_spark import rules
from narrative_spark.functions import text as T
from narrative_spark.operators import segment


def apply(spark, function, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "k int, x string")
    return [r[0] for r in rows.orderBy("k").select(function("x")).collect()]


ADS = ["本站域名：某某", "全文阅读请点这里", "　添加书签", "手机版更方便", "翻页", "投月票", "投推荐票", "求 打赏", "【全文完】", "www.x.y/z", "故事未完待续"]
PROSE = ["一枚书签落在了地上", "上一章乐曲刚停", "卖月票的窗口关了", "本章完全不提此事", "墙上刷着 www.a.b 几个字", "订阅晚报的人少了", "她的手机响了两声", "返回目录室取书"]


def test_ad_lines(spark):
    assert apply(spark, T.is_ad_line, ADS) == [True] * len(ADS)
    assert apply(spark, T.is_ad_line, PROSE) == [False] * len(PROSE)


def test_clean_text_is_idempotent(spark):
    raw = "甲　\r\n\r\n\r\n\r\n乙\r翻页\n丙 \n【全文完】\n"
    once = apply(spark, T.clean_text, [raw, "", None])
    assert once[0] == "甲\n\n乙\n丙" and once[1] == "" and once[2] is None
    assert apply(spark, T.clean_text, once[:2]) == once[:2]


def test_headings(spark):
    yes = ["第三章 渡口", "第27章：借火", "第４５回 灯市", "楔子", "外传 山中岁月", "第九章.渡口", "第六节　旧信", "后记"]
    no = ["第一章节选自别处", "第五章最后一盏灯灭了", "第二章写完了。", "尾声部分他重写了许多回", "我翻到第三章就睡了", "", "  ", "引", "第八章" + "长" * 60]
    assert apply(spark, T.chapter_title, yes) == yes and apply(spark, T.chapter_title, no) == [None] * len(no)


def test_chunks(spark):
    inputs = ["字" * 250, "一二三。" * 60, "", "a\n" * 50, "短。"]
    got = apply(spark, lambda c: T.chunks(c, 100), inputs)
    assert [len(x) for x in got[0]] == [100, 100, 50]
    assert all(len(x) == 100 and x.endswith("。") for x in got[1][:2]) and "".join(got[1]) == inputs[1]
    assert got[2] == [] and got[4] == ["短。"]
    with pytest.raises(ValueError):
        T.chunks("x", 1)


def loop_batches(passages, most):
    """The packing as a plain loop."""
    out, now = [], ""
    for p in passages:
        while len(p) > most:
            if now:
                out.append(now)
                now = ""
            out.append(p[:most])
            p = p[most:]
        if now and len(now) + 2 + len(p) > most:
            out.append(now)
            now = ""
        now = now + "\n\n" + p if now else p
    return [*out, now] if now else out


def test_batches(spark):
    cases = [["a" * 5, "b" * 3, "c" * 12, "d"], [], ["x" * 10], ["x" * 21, "y"], ["a" * 4, "b" * 4, "c" * 4], ["q" * 10, "r" * 10]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, p array<string>")
    got = [r[0] for r in rows.orderBy("k").select(segment.batches(F.col("p"), 10)).collect()]
    assert got == [loop_batches(c, 10) for c in cases]


def test_paragraphs(spark):
    got = apply(spark, lambda c: T.paragraphs(c, 10), ["a\nb\n\nc", "x" * 11 + "\ny\n\nz", ""])
    assert got == [["a\nb", "c"], ["x" * 11, "y", "z"], []]


def test_small_functions(spark):
    assert apply(spark, T.display_width, ["ab", "趙x", ""]) == [2, 3, 0]
    assert apply(spark, T.simplified, ["趙學a"]) == ["赵学a"]
    assert apply(spark, T.for_matching, ["「顾南舟 收起伞。」", None]) == ["顾南舟收起伞", ""]
    assert apply(spark, T.quote_field, ["desire@ch3", "flaw"]) == ["desire", "flaw"]
    assert apply(spark, T.clean_name, ["「 趙白」", "'x'"]) == ["趙白", "x"]
    assert apply(spark, lambda c: T.book_id(c, F.lit("z")), ["/a/《名》.txt", "b/x y:z.txt", "/c/《》.txt"])[:2] == ["名", "x_y_z"]
    assert apply(spark, T.safe_id, ["a/b:c", " x. "]) == ["abc", "x"]
    with pytest.raises(Exception, match="identifier is empty"):
        apply(spark, T.safe_id, ["/:"])
    assert apply(spark, lambda c: T.render(c, {"a": F.lit("1")}), ["{a} {b} {a}"]) == ["1 {b} 1"]
    assert apply(spark, T.preview, ["x" * 41, "y"]) == ["x" * 40 + "…", "y"]
    assert len(rules.TRADITIONAL) == len(rules.SIMPLIFIED)


def books(spark, rows):
    return spark.createDataFrame(rows, "book_id string, text string")


def listed(df):
    return [tuple(r) for r in df.orderBy("book_id", "chapter_index").collect()]


def test_segment_plans(spark):
    headed = "\n".join(["书名", *(x for k in range(1, 4) for x in (f"第{k}章 题{k}", f"正文{k}。" * 3))])
    separated = "\n".join(x for k in range(6) for x in (f"题{k}", "-----", f"文{k}。"))
    rows = [("a", headed), ("b", separated), ("c", "没有标记。" * 10), ("d", headed + "\n-----\n尾")]
    rows += [("e", "第一章 空\n\n第二章 也空\n  \n第三章 还空"), ("f", "短序\n第一章\n第二章"), ("g", "长" * 200 + "\n第一章\n")]
    # many separators, but hardly a chapter between them: headings stay
    rows += [("h", "第一章 甲\n文\n" + "-----\n" * 9 + "末\n第二章 乙\n文")]
    plans = {r.book_id: r.plan for r in segment.marker_counts(books(spark, rows)).collect()}
    assert plans == {"a": "headings", "b": "separators", "c": "length", "d": "headings", "e": "length", "f": "length", "g": "headings", "h": "headings"}
    got = listed(segment.segment(books(spark, rows), 20))
    assert [r[1:] for r in got if r[0] == "a"] == [(k - 1, f"第{k}章 题{k}", f"正文{k}。" * 3) for k in range(1, 4)]
    assert [r[1:] for r in got if r[0] == "b"] == [(k, f"题{k}", f"文{k}。") for k in range(6)]
    assert [len(r[3]) for r in got if r[0] == "c"] == [20, 20, 10]
    assert [r[2] for r in got if r[0] == "f"] == ["第1节"] and [r[2] for r in got if r[0] == "g"] == ["（卷首）", "第一章"]


def test_separator_chapters_are_counted_as_they_are_cut(spark):
    import random

    r, rows = random.Random(6), []
    for k in range(150):
        lines = [r.choice(("", "  ", "----", "====", "短", "长" * 30, "长" * 130)) for _ in range(r.randint(1, 14))]
        rows.append((f"b{k:03}", "\n".join(lines)))
    cut = {x.book_id: x.n for x in segment.by_separators(books(spark, rows)).groupBy("book_id").agg(F.count("*").alias("n")).collect()}
    got = {x.book_id: x.segments for x in segment.marker_counts(books(spark, rows)).collect()}
    assert got == {b: cut.get(b, 0) for b, _ in rows} and sum(got.values()) > 100


def test_plans_move_no_text_they_needn_t(spark):
    """The number of a part comes from counts: no window has a text in it, and a book's plan needs no join."""
    chapters = spark.createDataFrame([("a", 0, "T", "x")], "book_id string, chapter_index int, title string, content string")
    plan = segment.split_long(chapters, 20)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.split("\n") if "Window" in line)
    assert "content" not in window and "row_number" not in plan
    whole = segment.segment(books(spark, [("a", "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in whole


def test_preface(spark):
    long = "引" * 200
    got = listed(segment.by_headings(books(spark, [("a", long + "\n第一章\n文"), ("b", "短\n第一章\n文"), ("c", "无")])))
    assert got == [("a", 0, "（卷首）", long), ("a", 1, "第一章", "文"), ("b", 0, "第一章", "文")]


def test_split_long(spark):
    rows = spark.createDataFrame([("a", 0, "T", " 短 "), ("a", 1, "U", "十个字的一句话啊呀。" * 5), ("a", 2, "V", "末")], "book_id string, chapter_index int, title string, content string")
    got = listed(segment.split_long(rows, 20))
    assert [r[1:3] for r in got] == [(0, "T"), (1, "U（1/3）"), (2, "U（2/3）"), (3, "U（3/3）"), (4, "V")] and got[0][3] == " 短 "


def test_passages(spark):
    rows = spark.createDataFrame([("a", 0, "T", "T\n甲在\n\n乙在\n\n无")], "book_id string, chapter_index int, title string, content string")
    assert [r.passage for r in segment.passages(rows, ["甲", "乙", ""], keep_title=False).orderBy("pos").collect()] == ["甲在", "乙在"]
    assert segment.passages(rows, []).count() == 0


def test_white_space_of_all_scripts(spark):
    odd = "\u3000\u2003\x85 x\u00a0y\u2028"
    assert apply(spark, T.strip, [odd, " ", None]) == ["x\u00a0y", "", None]
    assert T.unicode_spaces(r"a\s[^\s。]\d") == f"a[{rules.SPACE}][^{rules.SPACE}。]\\d"
    assert apply(spark, T.iso_timestamp, ["2024-03-01 10:20:30.5"]) == ["2024-03-01T10:20:30+00:00"]

"""The engine's queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import model
from ..functions import text as T
from ..operators import aliases, cards, logs, names, persona, segment, validate
from ..runtime import kept
from ..sources import files
from ..sources.catalog import Catalog
from . import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKEN = r"\p{Lu}\p{Ll}{3,}"
ALIASES = ["moron", "Licensed", "password"]
PHRASES = ("of the", "in the", "est un", "und der")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters: a source is a book, a document one of its chapters."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), F.col("lang").alias("title"), F.col("text").alias("content"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of a character: the user is the character, the event's number its chapter."""
    return read(spark, sf_dir, "events").select(
        F.lit("b").alias("book_id"), F.col("user_id").alias("character"), F.col("event_id").alias("chapter_index"), F.lit(0).alias("field_no"), F.lit("personality").alias("field"), F.col("event_type").alias("value")
    )


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], *cols: str) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({', '.join(cols)})"


# ---- cleaning and segmentation

_JUNK = " OR ".join(f"regexp_matches(x, '{p}')" for p in (r"(?i)^[ \t　]*(?:https?://|www\.)\S+[ \t　]*$", *rules.LATIN_JUNK))
_CLEAN = rf"trim(regexp_replace(list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: NOT ({_JUNK})), 'string_agg', chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"


@query(rf"SELECT doc_id, md5(coalesce({_CLEAN}, '')) AS digest, length(coalesce({_CLEAN}, '')) AS n FROM documents")
def q01_clean_text(spark, sf_dir):
    text = T.clean_text("text", rules.LATIN_JUNK)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.length(text).cast("bigint").alias("n"))


@query(
    rf"""SELECT source, count(*) FILTER (WHERE bad) AS dropped, count(*) FILTER (WHERE NOT bad) AS kept
    FROM (SELECT source, ({_JUNK}) AS bad FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents)) GROUP BY source"""
)
def q02_noise_lines(spark, sf_dir):
    flat = read(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    bad = T.is_ad_line("line", rules.LATIN_JUNK)
    return flat.groupBy("source").agg(F.count_if(bad).alias("dropped"), F.count_if(~bad).alias("kept"))


_SP = "|".join(rules.SPECIAL_TITLES)
_NUMBERED = rf"^第\s*[{rules.NUMERALS}]+\s*[{rules.UNITS}](?:[ \t　]*[:：、.．·]?[ \t　]*)(.{{0,40}})$"
_SPECIAL = rf"^(?:{_SP})[ \t　]*[:：、.．·]?[ \t　]*(.{{0,40}})$"


def _title(s: str) -> str:
    """The heading that a stripped line is, or null, without look-ahead."""
    tail, suffix = f"regexp_extract({s}, '{_NUMBERED}', 1)", f"regexp_extract({s}, '{_SPECIAL}', 1)"
    bad = "[。！？；!?;]"
    return f"""CASE WHEN {s} = '' OR length({s}) > 50 THEN NULL
      WHEN regexp_matches({s}, '{_NUMBERED}') THEN CASE WHEN regexp_matches({tail}, '^[{rules.UNITS}]') OR regexp_matches({tail}, '^(?:{"|".join(rules.FALSE_FRIENDS)})[一-鿿]') OR regexp_matches({tail}, '{bad}') THEN NULL ELSE {s} END
      WHEN regexp_matches({s}, '{_SPECIAL}') AND NOT regexp_matches({s}, '^(?:{_SP})[{rules.UNITS}]') THEN CASE WHEN (regexp_matches({suffix}, '^[一-鿿]') AND length({suffix}) > 6) OR regexp_matches({suffix}, '{bad}') THEN NULL ELSE {s} END END"""


#: What a document's lines get in front, by turns, so that headings of all kinds and their near misses come up.
STARTS = ("", "第12章 ", "序章：", "第三回", "楔子 旧事", "第一章节", "第二章最后中", "番外 之后的事情有很多", "第１０回 ")
_STARTED = "CASE (doc_id + k) % 9 " + " ".join(f"WHEN {k} THEN '{x}' || line" for k, x in enumerate(STARTS)) + " END"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
    s AS (SELECT doc_id, k, trim({_STARTED}, ' 　' || chr(9)) AS s FROM l), t AS (SELECT doc_id, k, {_title("s")} AS t FROM s)
    SELECT doc_id, count(t) AS titles, count(*) AS lines, md5(coalesce(string_agg(t, '|' ORDER BY k), '')) AS digest FROM t GROUP BY 1"""
)
def q03_heading_titles(spark, sf_dir):
    """Every line of every document, as it is or behind the beginning of a heading."""
    flat = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    start = F.element_at(F.array(*map(F.lit, STARTS)), ((F.col("doc_id") + F.col("k")) % 9 + 1).cast("int"))
    title = flat.select("doc_id", "k", T.chapter_title(F.concat(start, "line")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("k", "t")))), lambda x: x["t"])
    return title.groupBy("doc_id").agg(F.count("t").alias("titles"), F.count("*").alias("lines"), F.md5(F.array_join(ordered, "|").cast("binary")).alias("digest"))


_HEAD = "length(trim(line)) BETWEEN 1 AND 24"


@query(
    f"""WITH l AS (SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    f AS (SELECT *, {_HEAD} AS head, sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY k) AS seg FROM l),
    g AS (SELECT book_id, seg, max(CASE WHEN head THEN line END) AS title, coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY k), '') AS body FROM f GROUP BY 1, 2),
    h AS (SELECT *, max(seg) OVER (PARTITION BY book_id) AS top FROM g)
    SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY seg) - 1 AS chapter_index, coalesce(title, '（卷首）') AS title, md5(trim(body, ' ' || chr(10) || chr(9))) AS digest
    FROM h WHERE top > 0 AND (seg > 0 OR length(trim(body, ' ' || chr(10) || chr(9))) >= 200)"""
)
def q04_segment_by_heading(spark, sf_dir):
    title = F.when(F.length(F.trim("line")).between(1, 24), F.col("line"))
    found = segment.by_headings(books(spark, sf_dir), title)
    return found.select("book_id", "chapter_index", "title", F.md5(F.col("content").cast("binary")).alias("digest"))


_MARKED = "list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) < 40 THEN '-----' WHEN length(x) BETWEEN 90 AND 110 THEN '第1章 ' || x ELSE x END)"


def marked_books(spark: SparkSession, sf_dir: str, headings: bool = True) -> DataFrame:
    """Documents as books in which a short line is a separator and one of some length the title above or a heading."""
    n = F.length
    line = lambda x: F.when(n(x) < 40, "-----").when(n(x).between(90, 110) & F.lit(headings), F.concat(F.lit("第1章 "), x)).otherwise(x)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


_LINED = _MARKED.replace("WHEN length(x) BETWEEN 90 AND 110 THEN '第1章 ' || x ", "")


def _separated(lines: str, longest: int = 60) -> str:
    """The chapters between separators, from windows over the lines."""
    up, down = "OVER (PARTITION BY book_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "OVER (PARTITION BY book_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return rf"""b AS (SELECT doc_id AS book_id, {lines} AS ls FROM documents),
    l AS (SELECT book_id, trim(unnest(ls), ' ' || chr(9)) AS line, generate_subscripts(ls, 1) AS k FROM b),
    f AS (SELECT *, regexp_matches(line, '^[\-—–_=]{{4,}}$') AS sep FROM l),
    p AS (SELECT *, max(CASE WHEN line <> '' THEN k END) {up} AS pk FROM f),
    t AS (SELECT p.*, CASE WHEN p.sep AND NOT q.sep AND length(q.line) <= {longest} THEN q.line END AS title, CASE WHEN p.sep AND NOT q.sep AND length(q.line) <= {longest} THEN p.pk END AS tk FROM p LEFT JOIN f q ON q.book_id = p.book_id AND q.k = p.pk),
    s AS (SELECT *, sum(CASE WHEN sep THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY k) AS seg, min(CASE WHEN sep THEN k END) {down} AS nk FROM t),
    u AS (SELECT s.*, z.tk AS ntk FROM s LEFT JOIN t z ON z.book_id = s.book_id AND z.k = s.nk),
    g AS (SELECT book_id, seg, max(title) AS title, trim(coalesce(string_agg(CASE WHEN NOT sep AND (ntk IS NULL OR k < ntk) THEN line END, chr(10) ORDER BY k), ''), ' ' || chr(10)) AS content FROM u GROUP BY 1, 2),
    h AS (SELECT *, max(seg) OVER (PARTITION BY book_id) AS top FROM g),
    sc AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY seg) - 1 AS chapter_index, CASE WHEN seg = 0 THEN '（卷首）' ELSE coalesce(title, '第' || CAST(seg AS VARCHAR) || '节') END AS title, content
      FROM h WHERE top > 0 AND ((seg > 0 AND content <> '') OR (seg = 0 AND length(content) >= 120)))"""


@query(f"WITH {_separated(_LINED)} SELECT book_id, chapter_index, title, md5(content) AS digest FROM sc")
def q05_segment_by_separator(spark, sf_dir):
    found = segment.by_separators(marked_books(spark, sf_dir, False), longest=60)
    return found.select("book_id", "chapter_index", "title", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    rf"""WITH {_separated(_MARKED, 24)}, m AS (SELECT book_id, k, line, sep, {_title("line")} IS NOT NULL AS head FROM f),
    c AS (SELECT book_id, count(*) FILTER (WHERE head) AS headings, count(*) FILTER (WHERE sep) AS separators, min(CASE WHEN head THEN k END) AS fk FROM m GROUP BY 1),
    n AS (SELECT book_id, count(*) AS n FROM sc GROUP BY 1),
    e AS (SELECT m.book_id, bool_or(m.k > c.fk AND line <> '' AND NOT head) AS said, length(trim(coalesce(string_agg(CASE WHEN m.k < c.fk THEN line END, chr(10) ORDER BY m.k), ''), ' ' || chr(10))) >= 200 AS preface FROM m JOIN c ON c.book_id = m.book_id GROUP BY 1),
    o AS (SELECT c.*, CASE WHEN separators > 0 AND separators + 1 > 2 * headings THEN coalesce(n, 0) ELSE 0 END AS segments, headings > 0 AND (said OR preface) AS headed FROM c LEFT JOIN n ON n.book_id = c.book_id JOIN e ON e.book_id = c.book_id)
    SELECT book_id, headings, separators, segments, CASE WHEN segments > 0 AND segments > 2 * headings THEN 'separators' WHEN headed THEN 'headings' ELSE 'length' END AS plan FROM o"""
)
def q06_segmentation_plan(spark, sf_dir):
    return segment.marker_counts(marked_books(spark, sf_dir))


_CHUNK = r"(?s)(.{1,299}\z|.{0,299}[.!?\n]|.{300})"
_STRIP = "trim(x, ' ' || chr(10) || chr(9))"


@query(
    f"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{_CHUNK}', 1), lambda x: {_STRIP}), lambda x: x <> '') AS c FROM documents)
    SELECT doc_id, generate_subscripts(c, 1) - 1 AS part, md5(unnest(c)) AS digest FROM c"""
)
def q07_chunk_sentences(spark, sf_dir):
    parts = T.chunks("text", 300, ".!?\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("part", "chunk")).select("doc_id", "part", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(
    rf"""WITH c AS (SELECT source AS book_id, doc_id, lang, CASE WHEN length(text) > 300 THEN list_filter(list_transform(regexp_extract_all(text, '(?s)(.{{1,299}}\z|.{{0,299}}[。！？!?…”』」\n]|.{{300}})', 1), lambda x: {_STRIP}), lambda x: x <> '') ELSE [text] END AS c FROM documents),
    e AS (SELECT book_id, doc_id, lang, len(c) AS n, generate_subscripts(c, 1) AS i, unnest(c) AS content FROM c)
    SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id, i) - 1 AS chapter_index, CASE WHEN n > 1 THEN lang || '（' || CAST(i AS VARCHAR) || '/' || CAST(n AS VARCHAR) || '）' ELSE lang END AS title, md5(content) AS digest FROM e"""
)
def q08_split_long(spark, sf_dir):
    return segment.split_long(chapters(spark, sf_dir), 300).select("book_id", "chapter_index", "title", F.md5(F.col("content").cast("binary")).alias("digest"))


_BLOCKS = rf"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {_STRIP}), lambda x: x <> '')"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP}), lambda x: x <> '')"
_PARAS = f"CASE WHEN coalesce(list_max(list_transform({_BLOCKS}, lambda x: length(x))), 0) > 1200 THEN {_LINES} ELSE {_BLOCKS} END"


@query(f"SELECT doc_id, len(p) AS blocks, md5(coalesce(list_aggregate(p, 'string_agg', '|'), '')) AS digest FROM (SELECT doc_id, {_PARAS} AS p FROM documents)")
def q09_paragraphs(spark, sf_dir):
    p = T.paragraphs("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(p).alias("blocks"), F.md5(F.array_join(p, "|").cast("binary")).alias("digest"))


@query(
    f"""WITH p AS (SELECT source AS book_id, doc_id AS chapter_index, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS passage FROM (SELECT source, doc_id, {_PARAS} AS p FROM documents))
    SELECT book_id, chapter_index, pos, md5(passage) AS digest FROM p WHERE {" OR ".join(f"contains(passage, '{n}')" for n in ALIASES)}"""
)
def q10_passage_retrieval(spark, sf_dir):
    return segment.passages(chapters(spark, sf_dir), ALIASES).select("book_id", "chapter_index", "pos", F.md5(F.col("passage").cast("binary")).alias("digest"))


_BATCHED = f"""WITH RECURSIVE d AS (SELECT doc_id, {_PARAS} AS p FROM documents),
    x AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM d), y AS (SELECT *, (length(t) - 1) // 2000 AS f, substr(t, ((length(t) - 1) // 2000) * 2000 + 1) AS r FROM x),
    w AS (SELECT doc_id, i, f, CAST(f AS BIGINT) AS batch, length(r) AS held FROM y WHERE i = 1
      UNION ALL SELECT y.doc_id, y.i, y.f, w.batch + CASE WHEN y.f > 0 THEN y.f + 1 WHEN w.held + 2 + length(y.r) > 2000 THEN 1 ELSE 0 END,
        CASE WHEN y.f > 0 OR w.held + 2 + length(y.r) > 2000 THEN length(y.r) ELSE w.held + 2 + length(y.r) END FROM w JOIN y ON y.doc_id = w.doc_id AND y.i = w.i + 1),
    b AS (SELECT w.doc_id, w.batch, string_agg(y.r, chr(10) || chr(10) ORDER BY w.i) AS text FROM w JOIN y ON y.doc_id = w.doc_id AND y.i = w.i GROUP BY 1, 2
      UNION ALL SELECT w.doc_id, w.batch - w.f + j, substr(y.t, j * 2000 + 1, 2000) FROM (SELECT *, unnest(range(f)) AS j FROM w) w JOIN y ON y.doc_id = w.doc_id AND y.i = w.i)
    SELECT doc_id, batch, length(text) AS n, md5(text) AS digest FROM b"""


@query(_BATCHED)
def q11_passage_batches(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    packed = segment.batches(T.paragraphs("text"), 2000)
    return docs.select("doc_id", F.posexplode(packed).alias("batch", "text")).select("doc_id", "batch", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


# ---- names

_MENTIONS = f"m AS (SELECT DISTINCT source AS book_id, doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS name FROM documents)"
_RANKED = "r AS (SELECT book_id, name, count(DISTINCT doc_id) AS chapter_count, count(*) AS mentions, row_number() OVER (PARTITION BY book_id ORDER BY count(DISTINCT doc_id) DESC, count(*) DESC, name) AS rank FROM m GROUP BY 1, 2)"


def _ranked(spark, sf_dir, top):
    return names.rank(names.name_tokens(chapters(spark, sf_dir), TOKEN), top)


@query(f"WITH {_MENTIONS}, {_RANKED} SELECT book_id, rank, name, chapter_count, mentions FROM r WHERE rank <= 15")
def q12_rank_candidates(spark, sf_dir):
    return _ranked(spark, sf_dir, 15).select("book_id", "rank", "name", "chapter_count", "mentions")


_SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda x: trim(x)), lambda x: length(x) >= 4)"


@query(
    f"""WITH {_MENTIONS}, {_RANKED}, s AS (SELECT source AS book_id, doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence FROM (SELECT source, doc_id, {_SENT} AS s FROM documents)),
    j AS (SELECT r.book_id, r.name, s.sentence, row_number() OVER (PARTITION BY r.book_id, r.name ORDER BY s.doc_id, s.pos) AS k FROM r JOIN s ON r.book_id = s.book_id AND contains(s.sentence, r.name) WHERE r.rank <= 15)
    SELECT * FROM j WHERE k <= 3"""
)
def q13_context_sentences(spark, sf_dir):
    found = F.regexp_extract_all("content", F.lit("[^.!?\n]+[.!?]?"), 0)
    cut = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) >= 4)
    return names.contexts(_ranked(spark, sf_dir, 15), chapters(spark, sf_dir), 3, cut).select("book_id", "name", "sentence", "k")


def _cache(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(TOKEN), 0).alias("found"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "found"))), lambda x: x["found"])
    return turns.groupBy(F.lit("b").alias("book_id"), F.col("conv_id").alias("chapter_index")).agg(rows.alias("chunks"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, generate_subscripts(f, 1) AS pos, unnest(f) AS name FROM (SELECT conv_id, turn, regexp_extract_all(text, '{TOKEN}') AS f FROM conversations)),
    u AS (SELECT conv_id, name, min(turn * 1000000 + pos) AS o FROM t GROUP BY 1, 2)
    SELECT c.conv_id AS chapter_index, count(u.name) AS n, md5(coalesce(string_agg(u.name, '|' ORDER BY o), '')) AS digest FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON u.conv_id = c.conv_id GROUP BY 1"""
)
def q14_chapter_name_union(spark, sf_dir):
    return names.chapter_names(_cache(spark, sf_dir)).select("chapter_index", F.size("names").alias("n"), F.md5(F.array_join("names", "|").cast("binary")).alias("digest"))


#: Letters that stand for characters with two spellings, so that whole documents have both.
_LETTERS = "aeioust"
_SIMPLE, _TRAD = rules.SIMPLIFIED[: len(_LETTERS)], rules.TRADITIONAL[: len(_LETTERS)]
_SPELT = f"s AS (SELECT source AS book_id, translate(text, '{_LETTERS}', CASE WHEN source < 'src4' THEN '{_TRAD}' ELSE '{_SIMPLE}' END) AS text FROM documents)"
_CALLED = f"n AS (SELECT DISTINCT book_id, translate(name, '{_LETTERS}', CASE WHEN rank % 3 = 0 THEN '{_TRAD}' ELSE '{_SIMPLE}' END) || CASE WHEN rank = 15 THEN '趙' ELSE '' END AS name FROM r WHERE rank <= 15)"
_FORMS = f"""{_MENTIONS}, {_RANKED}, {_SPELT}, {_CALLED}, v AS (SELECT *, translate(name, '{rules.SIMPLIFIED}', '{rules.TRADITIONAL}') AS t, translate(name, '{rules.TRADITIONAL}', '{rules.SIMPLIFIED}') AS z FROM n),
    h AS (SELECT v.book_id, v.name, v.t, v.z, bool_or(contains(text, name)) AS a, bool_or(contains(text, t)) AS b, bool_or(contains(text, z)) AS c FROM v JOIN s ON s.book_id = v.book_id GROUP BY 1, 2, 3, 4),
    forms AS (SELECT book_id, name, CASE WHEN a THEN name WHEN b THEN t WHEN c THEN z ELSE name END AS form FROM h)"""


def _forms(spark, sf_dir):
    """The names of each source in one script, its texts in the other or the same."""
    swap = lambda c, other: F.translate(c, _LETTERS, other)
    texts = chapters(spark, sf_dir).withColumn("content", F.when(F.col("book_id") < "src4", swap("content", _TRAD)).otherwise(swap("content", _SIMPLE)))
    called = _ranked(spark, sf_dir, 15).select("book_id", F.concat(F.when(F.col("rank") % 3 == 0, swap("name", _TRAD)).otherwise(swap("name", _SIMPLE)), F.when(F.col("rank") == 15, "趙").otherwise("")).alias("name"))
    return names.source_forms(called, texts)


@query(f"WITH {_FORMS} SELECT * FROM forms")
def q15_variant_forms(spark, sf_dir):
    return _forms(spark, sf_dir)


@query(f"WITH {_FORMS} SELECT * FROM forms WHERE name <> form")
def q49_renamed(spark, sf_dir):
    return names.renamed(_forms(spark, sf_dir))


def _prints(spark, sf_dir, edited: bool) -> DataFrame:
    rows = chapters(spark, sf_dir)
    if edited:  # one language was edited since the cache was written, one source never scanned
        rows = rows.where("book_id <> 'src3'").withColumn("content", F.when(F.col("title") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return names.with_fingerprint(rows, 300).select(*names.KEY)


_PIECES = rf"CASE WHEN length(text) <= 300 THEN [text] ELSE list_filter(list_transform(regexp_extract_all(text, '(?s)(.{{1,299}}\z|.{{0,299}}[。！？!?…”』」\n]|.{{300}})', 1), lambda x: {_STRIP}), lambda x: x <> '') END"


@query(f"SELECT source AS book_id, doc_id AS chapter_index, substr(sha1(lang || chr(0) || array_to_string({_PIECES}, chr(0))), 1, 16) AS fingerprint FROM documents WHERE source = 'src3' OR lang = 'fr'")
def q16_cache_misses(spark, sf_dir):
    return names.cache_misses(_prints(spark, sf_dir, False), _prints(spark, sf_dir, True))


@query("SELECT book_id, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM (SELECT source AS book_id, NOT (source = 'src3' OR lang = 'fr') AS hit FROM documents) GROUP BY 1")
def q17_cache_union(spark, sf_dir):
    now, cache = _prints(spark, sf_dir, False), _prints(spark, sf_dir, True)
    both = names.cache_hits(now, cache).withColumn("hit", F.lit(True)).unionByName(names.cache_misses(now, cache).withColumn("hit", F.lit(False)))
    return both.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


# ---- aliases

#: Words that become marks of kinship or identity, so that whole documents have them; short runs of letters are names.
_SWAPS = ((" with ", "的父親名叫"), (" by ", "，即是"), (" are ", "就是"), (" des ", "的女兒就是"), (" und ", "，小名"), (" les ", "叫做"))
_RUN = "[a-z]{3,4}"


def _swapped(text: str) -> str:
    for a, b in _SWAPS:
        text = f"replace({text}, '{a}', '{b}')"
    return text


_FAM = r"([^\s。！？；，、]{2,8})[^\n。！？；]{0,6}(" + "|".join(rules.KINSHIP) + r")[^\n。！？；]{0,6}?(" + "|".join(rules.COPULAS) + r")([^\s。！？；，、]{2,8})"
_TOLD = f"told AS (SELECT source AS book_id, doc_id, {_swapped('text')} AS text FROM documents)"
_PEOPLE = f"""pm AS (SELECT DISTINCT book_id, doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS name FROM told),
    pr AS (SELECT book_id, name, row_number() OVER (PARTITION BY book_id ORDER BY count(DISTINCT doc_id) DESC, count(*) DESC, name) - 1 AS pos FROM pm GROUP BY 1, 2), n AS (SELECT * FROM pr WHERE pos < 15)"""
_REL = f"""cl AS (SELECT book_id, doc_id, generate_subscripts(c, 1) - 1 AS no, unnest(c) AS clause FROM (SELECT book_id, doc_id, string_split_regex(text, '{rules.CLAUSE_END}') AS c FROM told)),
    rel AS (SELECT book_id, (doc_id << 32) + no * 256 + generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS "left", unnest(k) AS kin, unnest(r) AS "right"
    FROM (SELECT book_id, doc_id, no, regexp_extract_all(clause, '{_FAM}', 1) AS l, regexp_extract_all(clause, '{_FAM}', 2) AS k, regexp_extract_all(clause, '{_FAM}', 4) AS r FROM cl)), rl AS (SELECT * FROM rel WHERE "left" <> "right")"""
_BARRED = """fp AS (SELECT r.book_id, least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, r."left" || '…' || kin || '…' || r."right" AS proof, row_number() OVER (PARTITION BY r.book_id ORDER BY seq, x.pos, y.pos) AS k
      FROM rl r JOIN n x ON x.book_id = r.book_id AND contains(r."left", x.name) JOIN n y ON y.book_id = r.book_id AND contains(r."right", y.name) WHERE x.name <> y.name),
    barred AS (SELECT book_id, a, b, max_by(proof, k) AS proof FROM fp WHERE k <= 200 GROUP BY 1, 2, 3)"""
_ALL_BARRED = _BARRED.replace("WHERE k <= 200 ", "")


def _texts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), "text")
    for a, b in _SWAPS:
        rows = rows.withColumn("text", F.replace("text", F.lit(a), F.lit(b)))
    return rows


def _names(spark, sf_dir):
    found = names.name_tokens(_texts(spark, sf_dir).withColumnRenamed("text", "content"), _RUN)
    return kept(names.rank(found, 15).select("book_id", (F.col("rank") - 1).alias("pos"), "name"), "people")


def _barred(spark, sf_dir, people, most=None):
    return aliases.forbidden_pairs(aliases.family_relations(_texts(spark, sf_dir)), people, most)


@query(f"WITH {_TOLD}, {_REL} SELECT * FROM rl")
def q18_family_relations(spark, sf_dir):
    return aliases.family_relations(_texts(spark, sf_dir))


@query(f"WITH {_TOLD}, {_PEOPLE}, {_REL}, {_BARRED} SELECT * FROM barred")
def q19_forbidden_pairs(spark, sf_dir):
    """The first pairs of a book, as many as the SQL counts."""
    return _barred(spark, sf_dir, _names(spark, sf_dir), rules.MOST_PAIRS)


def _occurring(tier: str, markers: tuple[str, ...], between: str) -> str:
    """Places of a tier's marks between two names, from the lengths of what stands between the matches."""
    low, high = rules.NAME_LENGTHS
    name = rules.NAME_CHARACTER + f"{{{low},{high}}}"
    pattern = f"({name})({rules.MARK_BETWEEN})({'|'.join(markers)})({between})({name})".replace("'", "''")
    part = lambda k: f"regexp_extract_all(text, '{pattern}', {k})"
    return f"""SELECT book_id, doc_id, text, '{tier}' AS tier, m, i, w, l, mk, rt, sum(length(p) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS place FROM (
      SELECT book_id, doc_id, text, 0 AS m, generate_subscripts({part(0)}, 1) AS i, unnest({part(0)}) AS w, unnest({part(1)}) AS l, unnest({part(3)}) AS mk, unnest({part(5)}) AS rt, unnest((string_split_regex(text, '{pattern}'))[:len({part(0)})]) AS p FROM told)"""


_EVIDENCE = f"""oc AS ({_occurring("forced", rules.STRONG_MARKERS, rules.MARK_BETWEEN)} UNION ALL {_occurring("hint", rules.WEAK_MARKERS, rules.WEAK_BETWEEN)}),
    oy AS (SELECT *, CAST(place AS BIGINT) AS pl FROM oc),
    oz AS (SELECT *, (doc_id << 32) + CAST(pl AS BIGINT) AS seq, row_number() OVER () AS id, substr(text, greatest(pl - 12, 0) + 1, pl + length(l) - greatest(pl - 12, 0)) AS until, substr(text, pl + length(w) - length(rt) + 1, length(rt) + 12) AS onwards,
      replace(substr(text, greatest(pl - 12, 0) + 1, pl + length(w) + 12 - greatest(pl - 12, 0)), chr(10), ' ') || '（标记：' || mk || '）' AS proof FROM oy),
    lf AS (SELECT id, arg_max(n.name, length(n.name) * 1000 - pos) AS x FROM oz JOIN n ON n.book_id = oz.book_id AND suffix(until, n.name) GROUP BY 1),
    rg AS (SELECT id, arg_max(n.name, length(n.name) * 1000 - pos) AS y FROM oz JOIN n ON n.book_id = oz.book_id AND prefix(onwards, n.name) GROUP BY 1),
    ev AS (SELECT oz.book_id, least(x, y) AS a, greatest(x, y) AS b, tier, proof, seq, CASE tier WHEN 'forced' THEN 0 ELSE 1 END AS o FROM oz JOIN lf ON lf.id = oz.id JOIN rg ON rg.id = oz.id
      WHERE x <> y AND NOT (length(onwards) > length(y) AND contains('{rules.NOT_AFTER_NAME}', substr(onwards, length(y) + 1, 1)))),
    al AS (SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM barred f WHERE f.book_id = ev.book_id AND f.a = ev.a AND f.b = ev.b)),
    fr AS (SELECT DISTINCT book_id, a, b FROM al WHERE o = 0),
    kp AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY o, seq) AS k FROM al WHERE o = 0 OR NOT EXISTS (SELECT 1 FROM fr WHERE fr.book_id = al.book_id AND fr.a = al.a AND fr.b = al.b)),
    evidence AS (SELECT book_id, a, b, arg_min(tier, k) AS tier, arg_min(proof, k) AS proof, min(k) AS seq FROM kp GROUP BY 1, 2, 3)"""


@query(f"WITH {_TOLD}, {_PEOPLE}, {_REL}, {_ALL_BARRED}, {_EVIDENCE} SELECT * FROM evidence")
def q20_same_person_evidence(spark, sf_dir):
    people = _names(spark, sf_dir)
    return aliases.evidence(aliases.marker_matches(_texts(spark, sf_dir), people), _barred(spark, sf_dir, people), None)


_E = f"""e AS (SELECT DISTINCT source AS book_id, f[1] AS a, f[2] AS b FROM (SELECT source, regexp_extract_all(text, '{TOKEN}') AS f FROM documents) WHERE len(f) > 1 AND f[1] <> f[2]),
    u AS (SELECT book_id, a AS x, b AS y FROM e UNION SELECT book_id, b, a FROM e)"""
_CC = f"{_E}, w AS (SELECT DISTINCT book_id, x, x AS z FROM u UNION SELECT w.book_id, w.x, u.y FROM w JOIN u ON u.book_id = w.book_id AND u.x = w.z), c AS (SELECT book_id, x AS name, min(z) AS root FROM w GROUP BY 1, 2)"


def _pairs(spark, sf_dir):
    """The first two names of each document of a source, as if each document proved them one person's."""
    found = F.regexp_extract_all("text", F.lit(TOKEN), 0)
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.get(found, F.lit(0)).alias("a"), F.get(found, F.lit(1)).alias("b"))
    return rows.where("a <> b").distinct()


@query(f"WITH RECURSIVE {_CC} SELECT * FROM c")
def q21_alias_components(spark, sf_dir):
    return aliases.components(_pairs(spark, sf_dir))


@query(
    rf"""WITH RECURSIVE {_CC}, m AS (SELECT *, first_value(name) OVER (PARTITION BY book_id, root ORDER BY length(name) + length(regexp_replace(name, '[\x00-\x{{2E80}}]', '', 'g')) DESC, name) AS main FROM c),
    f AS (SELECT DISTINCT book_id, least(a, b) AS a, greatest(a, b) AS b FROM e WHERE ascii(a) % 3 = 0)
    SELECT m.book_id, main, name AS alias FROM m WHERE name <> main AND NOT EXISTS (SELECT 1 FROM f WHERE f.book_id = m.book_id AND a = least(main, name) AND b = greatest(main, name))"""
)
def q22_alias_guard(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return aliases.guard(aliases.groups(pairs), pairs.where("ascii(a) % 3 = 0").select("book_id", *aliases.pair("a", "b")).distinct())


@query(
    f"""WITH {_MENTIONS}, {_RANKED}, mains AS (SELECT book_id, name FROM r WHERE rank <= 15), pool AS (SELECT DISTINCT book_id, unnest([substr(name, 1, 4), substr(name, 2), name]) AS name FROM mains UNION SELECT DISTINCT book_id, name FROM m)
    SELECT p.book_id, s.name AS main, p.name AS alias FROM pool p JOIN mains s ON s.book_id = p.book_id AND contains(s.name, p.name) AND s.name <> p.name WHERE NOT EXISTS (SELECT 1 FROM mains z WHERE z.book_id = p.book_id AND z.name = p.name)"""
)
def q23_short_forms(spark, sf_dir):
    mains = _ranked(spark, sf_dir, 15).select("book_id", "name")
    cut = mains.select("book_id", F.explode(F.array(F.substring("name", 1, 4), F.expr("substring(name, 2)"), "name")).alias("name"))
    pool = cut.unionByName(names.name_tokens(chapters(spark, sf_dir), TOKEN).select("book_id", "name")).distinct()
    return aliases.short_forms(pool, mains)


@query()
def q50_merged_groups(spark, sf_dir):
    """Groups as a model might tell them, of the frequent names of each source, merged by the evidence of the texts. The
    outcome depends on an order that SQL can't follow; tests hold the merging against worked cases."""
    people = _names(spark, sf_dir)
    barred = kept(_barred(spark, sf_dir, people), "barred")
    proofs = aliases.evidence(aliases.marker_matches(_texts(spark, sf_dir), people), barred, None).where("tier = 'forced'")
    a, b = (people.where(F.col("pos") % 5 == k).select("book_id", F.floor(F.col("pos") / 5).alias("pos"), F.col("name").alias(c)) for k, c in ((0, "main"), (1, "alias")))
    merged = aliases.merge_groups(a.join(b, ["book_id", "pos"]), proofs, people)
    return aliases.guard(merged, barred)


# ---- validation


def _quotes(spark, sf_dir):
    """Three quotes of each document: its second sentence, the same reversed, which the text doesn't hold, and a
    benchmark item, which some texts hold."""
    second = F.get(F.filter(F.transform(F.regexp_extract_all("text", F.lit("[^.!?\n]+[.!?]?"), 0), lambda x: F.trim(x)), lambda x: F.length(x) >= 4), F.lit(1))
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    rows = read(spark, sf_dir, "documents").withColumn("q", F.coalesce(second, F.lit(""))).withColumn("item_id", F.col("doc_id") % 40).join(items, "item_id", "left")
    quote = lambda pos, field, text: F.struct(F.lit(pos).alias("pos"), F.lit(field).alias("field"), F.coalesce(text, F.lit("")).alias("text"))
    each = F.array(quote(0, "personality", F.col("q")), quote(1, "desire@ch3", F.reverse("q")), quote(2, "flaw", F.col("item")))
    return rows.select(F.col("source").alias("book_id"), F.lit("c").alias("character"), F.col("doc_id").alias("chapter_index"), F.inline(each))


_IGN = r"[\s，。、；：？！“”‘’（）《》〈〉「」『』…—·,.;:?!\"''()\[\]<>~\-]+"
_Q = f"""q AS (SELECT source AS book_id, doc_id AS chapter_index, d.text AS body, coalesce({_SENT.replace("(text,", "(d.text,")}[2], '') AS q, coalesce(b.text, '') AS item FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40),
    qq AS (SELECT book_id, chapter_index, body, 'personality' AS field, q AS text FROM q UNION ALL SELECT book_id, chapter_index, body, 'desire@ch3', reverse(q) FROM q UNION ALL SELECT book_id, chapter_index, body, 'flaw', item FROM q),
    gr AS (SELECT book_id, chapter_index, field, text, regexp_replace(text, '{_IGN}', '', 'g') AS n, regexp_replace(body, '{_IGN}', '', 'g') AS s FROM qq),
    go AS (SELECT book_id, chapter_index, field, text, length(n) > 0 AND contains(s, n) AS grounded FROM gr)"""


@query(f"WITH {_Q} SELECT chapter_index, field, grounded FROM go")
def q24_quote_grounding(spark, sf_dir):
    return validate.ground_quotes(_quotes(spark, sf_dir), chapters(spark, sf_dir)).select("chapter_index", "field", "grounded")


_FIELDS = (("personality", "text"), ("desire", "lang"), ("flaw", "source"), ("secret", "lang"))


def _found(spark, sf_dir):
    """Four fields of each document: its whole text, its language, its source, and its language again."""
    rows = read(spark, sf_dir, "documents")
    each = F.array(*(F.struct(F.lit(k).alias("field_no"), F.lit(f).alias("field"), F.col(c).alias("value")) for k, (f, c) in enumerate(_FIELDS)))
    return rows.select(F.col("source").alias("book_id"), F.lit("c").alias("character"), F.col("doc_id").alias("chapter_index"), F.inline(each)).where("value <> ''")


def _told(spark, sf_dir):
    """A relation of each document, whose change is its whole text."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.lit("c").alias("character"), F.col("doc_id").alias("chapter_index"), F.col("lang").alias("target"), F.col("text").alias("change"))


_FI = f"""fi AS (SELECT source AS book_id, doc_id AS chapter_index, unnest({[f for f, _ in _FIELDS]}) AS field, unnest([{", ".join(c for _, c in _FIELDS)}]) AS value FROM documents), fv AS (SELECT * FROM fi WHERE value <> ''),
    off AS (SELECT book_id, chapter_index, split_part(field, '@ch', 1) AS field, max(CAST(grounded AS INT)) AS a FROM go GROUP BY 1, 2, 3),
    oc AS (SELECT fv.*, CASE WHEN a IS NULL THEN 'cleared' WHEN a = 0 THEN 'ungrounded' ELSE 'ok' END AS outcome FROM fv LEFT JOIN off ON off.book_id = fv.book_id AND off.chapter_index = fv.chapter_index AND off.field = fv.field)"""
_LOW = "CASE field " + " ".join(f"WHEN '{f}' THEN {a}" for f, (a, _) in rules.FIELD_LENGTHS.items()) + " END"
_HIGH = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, (_, b) in rules.FIELD_LENGTHS.items()) + " END"
_LENGTH_ITEM = f"field || ': ' || CAST(length(value) AS VARCHAR) || ' 字（要求 ' || CAST({_LOW} AS VARCHAR) || '–' || CAST({_HIGH} AS VARCHAR) || '）'"


@query(f"WITH {_Q}, {_FI} SELECT chapter_index, field, outcome FROM oc")
def q25_field_outcomes(spark, sf_dir):
    checked = validate.ground_quotes(_quotes(spark, sf_dir), chapters(spark, sf_dir))
    return validate.field_outcomes(_found(spark, sf_dir), checked).select("chapter_index", "field", "outcome")


_HIT = "CASE " + " ".join(f"WHEN contains(text, '{p}') THEN '{p}'" for p in PHRASES) + " END"


@query(f"SELECT doc_id, {_HIT} AS phrase FROM documents WHERE {_HIT} IS NOT NULL")
def q26_cliche_hits(spark, sf_dir):
    hit = validate.first_hit(F.col("text"), PHRASES)
    return read(spark, sf_dir, "documents").select("doc_id", hit.alias("phrase")).where("phrase is not null")


@query(f"WITH fi AS (SELECT doc_id AS chapter_index, unnest({[f for f, _ in _FIELDS]}) AS field, unnest([{', '.join(c for _, c in _FIELDS)}]) AS value FROM documents) SELECT chapter_index, {_LENGTH_ITEM} AS item FROM fi WHERE value <> '' AND (length(value) < {_LOW} OR length(value) > {_HIGH})")
def q27_length_findings(spark, sf_dir):
    return validate.length_findings(_found(spark, sf_dir)).select("chapter_index", "item")


_CLICHE = "CASE " + " ".join(f"WHEN contains(value, '{p}') THEN '{p}'" for p in PHRASES) + " END"


@query(
    f"""WITH v AS (SELECT doc_id AS chapter_index, unnest(['personality', 'relationships[' || lang || ']']) AS field, unnest([text, text]) AS value FROM documents)
    SELECT chapter_index, field || ': 命中套话「' || {_CLICHE} || '」' AS item FROM v WHERE {_CLICHE} IS NOT NULL"""
)
def q51_cliches(spark, sf_dir):
    """The first stock phrase of each document as a field and as a change of a relation."""
    found = _found(spark, sf_dir).where("field = 'personality'")
    return validate.cliche_findings(found, PHRASES, _told(spark, sf_dir)).select("chapter_index", "item")


# ---- personas

_LOG = "g AS (SELECT user_id, event_id, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events), log AS (SELECT * FROM g WHERE previous IS NULL OR previous <> value)"


@query(f"WITH {_LOG} SELECT user_id AS character, event_id AS chapter_index, value, previous FROM log")
def q28_change_log(spark, sf_dir):
    return persona.change_log(observations(spark, sf_dir)).select("character", "chapter_index", "value", "previous")


@query("SELECT user_id AS character, arg_max(event_type, event_id) AS personality, '' AS desire FROM events GROUP BY 1")
def q29_current_persona(spark, sf_dir):
    return persona.current(observations(spark, sf_dir)).select("character", "personality", "desire")


@query("SELECT user_id AS character, CASE WHEN a = z THEN z ELSE '早期：' || a || ' → 后期：' || z END AS text FROM (SELECT user_id, arg_min(event_type, event_id) AS a, arg_max(event_type, event_id) AS z FROM events GROUP BY 1)")
def q30_field_evolution(spark, sf_dir):
    return persona.evolution(persona.change_log(observations(spark, sf_dir))).select("character", "text")


@query("SELECT user_id AS character, event_id AS chapter_index, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS known FROM events")
def q31_running_persona(spark, sf_dir):
    return persona.running(observations(spark, sf_dir)).select("character", "chapter_index", "known")


def _relations(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.lit("b").alias("book_id"), F.col("user_id").alias("character"), F.col("event_id").alias("seq"), F.col("event_type").alias("target"), F.col("props").alias("change")
    )


@query("SELECT user_id AS character, event_type AS target, arg_max(props, event_id) AS description, md5(string_agg(props, '|' ORDER BY event_id)) AS digest, count(*) AS n FROM events GROUP BY 1, 2")
def q32_relation_evolution(spark, sf_dir):
    rows = persona.relation_rows(_relations(spark, sf_dir))
    return rows.select("character", "target", "description", F.md5(F.array_join("evolution", "|").cast("binary")).alias("digest"), "n")


_CHANGES = "ch AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM log WHERE previous IS NOT NULL)"


@query(
    f"""WITH {_LOG}, {_CHANGES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    l AS (SELECT user_id, 0 AS g, 0 AS o, '- 性格：' || arg_max(event_type, event_id) AS t FROM events GROUP BY 1
      UNION ALL SELECT user_id, 1, event_id, '- 与「' || event_type || '」：' || CASE WHEN length(props) > 5 THEN substr(props, 1, 5) || '…' ELSE props END FROM k WHERE k <= 12
      UNION ALL SELECT user_id, 2, 0, '- （另有 ' || CAST(n - 12 AS VARCHAR) || ' 条较早的关系变化已省略）' FROM k WHERE k = 1 AND n > 12
      UNION ALL SELECT user_id, 3, k, '- 变化（personality）：' || previous || ' → ' || value FROM ch WHERE k <= 5)
    SELECT l.user_id AS character, string_agg(t, chr(10) ORDER BY g, o) AS summary, max(greatest(0, n - 12)) AS omitted FROM l JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) c ON c.user_id = l.user_id GROUP BY 1"""
)
def q33_recent_summary(spark, sf_dir):
    found = observations(spark, sf_dir)
    changes = persona.conflicts(persona.change_log(found)).select("book_id", "character", F.col("chapter_index").alias("pos"), "field", "from", "to")
    return persona.summary(persona.current(found), _relations(spark, sf_dir), changes, chars=5).select("character", "summary", "omitted")


@query(f"WITH {_LOG} SELECT user_id AS character, event_id AS chapter_index, 'personality' AS field, previous AS \"from\", value AS \"to\", '第 ' || CAST(event_id AS VARCHAR) || ' 章的表述与已有画像不同，按 §7 保留较晚的并记录演化' AS reason FROM log WHERE previous IS NOT NULL")
def q53_conflicts(spark, sf_dir):
    return persona.conflicts(persona.change_log(observations(spark, sf_dir))).drop("book_id", "src", "pos")


@query("SELECT user_id AS character, event_id // 10 AS chapter_index, 'personality' AS field, arg_min(event_type, event_id) AS value FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def q54_first_of_batches(spark, sf_dir):
    """Ten events in turn are a chapter's batches; those without a value don't count."""
    rows = observations(spark, sf_dir).withColumns({"batch": F.col("chapter_index"), "chapter_index": F.floor(F.col("chapter_index") / 10), "value": F.when(F.col("value") == "view", " \u3000\n").otherwise(F.col("value"))})
    return persona.first_of_batches(rows).drop("book_id")


@query("""SELECT user_id AS character, array_to_string((list(event_type ORDER BY o))[:3], '|') AS samples, count(*) AS n FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY 1""")
def q55_speech_samples(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.lit("b").alias("book_id"), F.col("user_id").alias("character"), F.col("event_id").alias("chapter_index"), F.array("event_type").alias("speech_samples"))
    got = persona.samples(rows)
    return got.select("character", F.array_join(persona.speech_head(F.col("speech_samples"), 3), "|").alias("samples"), F.size("speech_samples").alias("n"))


@query("SELECT user_id AS character, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS empty FROM events GROUP BY 1")
def q56_empty_increments(spark, sf_dir):
    """Events as increments: a view says nothing, an error tells of a relation only."""
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_type").isin("view", "error"), "").otherwise(F.col("event_type"))
    told = F.when(F.col("event_type") == "error", F.array(F.struct(F.lit("x").alias("target"), F.lit("").alias("change"))))
    rows = e.select(F.col("user_id").alias("character"), text.alias("personality"), *(F.lit(None).cast("string").alias(f) for f in rules.FIELDS[1:]), told.alias("relationships"))
    return rows.groupBy("character").agg(F.count("*").alias("n"), F.count_if(persona.is_empty()).alias("empty"))


@query(
    f"""WITH {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS no FROM log)
    SELECT user_id AS character, no AS event_order, 't' || CAST(no AS VARCHAR) AS id, CASE WHEN previous IS NULL THEN 'personality：' || value ELSE 'personality：' || previous || ' → ' || value END AS summary, '第' || CAST(event_id AS VARCHAR) || '章' AS chapter, previous AS quote FROM o WHERE no < 200"""
)
def q34_timeline_events(spark, sf_dir):
    return persona.timeline_events(persona.change_log(observations(spark, sf_dir))).drop("book_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY 1, 2")
def q35_first_seen(spark, sf_dir):
    return persona.first_seen(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], ["event_id"])


# ---- logs


def _memory(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.lit("c").alias("character_id"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))


@query(f"WITH {_LOG} SELECT user_id AS id, arg_max(value, event_id) AS content, min(event_id) AS first_seq, count(*) AS writes FROM log GROUP BY 1")
def q36_memory_upsert(spark, sf_dir):
    return logs.memory(_memory(spark, sf_dir)).drop("character_id")


@query("SELECT u.user_id AS id, coalesce(n, 0) AS hits FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) v ON u.user_id = v.user_id")
def q37_memory_hits(spark, sf_dir):
    rows = _memory(spark, sf_dir)
    return logs.hits(rows.select("character_id", "id").distinct(), rows.where("content = 'view'")).select("id", "hits")


@query(
    "SELECT conv_id AS session_id, arg_max(role, turn) FILTER (WHERE role = 'user') AS state, count(text) AS n_messages, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1"
)
def q38_session_fold(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.when(F.col("role") == "user", F.col("role")).alias("state"), F.col("text").alias("message"))
    return logs.sessions(rows).select("session_id", "state", "n_messages", F.md5(F.array_join("messages", "|").cast("binary")).alias("digest"))


@query(
    "SELECT event_type AS model, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed, sum(user_id) AS prompt_tokens, sum(event_id) AS completion_tokens, 0 AS cached_tokens, sum(user_id + event_id) AS total_tokens FROM events GROUP BY 1"
)
def q39_usage_totals(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), (F.col("event_type") != "error").alias("ok"), F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"), F.lit(0).cast("bigint").alias("cached_tokens")
    )
    return logs.usage(calls)


@query(
    f"""WITH {_Q}, {_FI}, f AS (SELECT book_id, chapter_index, 'quote' AS rule, field || ': ' || substr(text, 1, 40) AS item FROM go WHERE NOT grounded
      UNION ALL SELECT book_id, chapter_index, 'length', {_LENGTH_ITEM} FROM fv WHERE length(value) < {_LOW} OR length(value) > {_HIGH}
      UNION ALL SELECT book_id, chapter_index, outcome, field FROM oc WHERE outcome <> 'ok')
    SELECT rule, count(*) AS n, count(DISTINCT item) AS items FROM f GROUP BY 1"""
)
def q40_validation_report(spark, sf_dir):
    _, findings = validate.validate(_found(spark, sf_dir), _quotes(spark, sf_dir), chapters(spark, sf_dir))
    return validate.report(findings)


@query(
    f"""WITH {_Q}, {_FI}, f AS (SELECT book_id, chapter_index, 'quote' AS rule, field || ': ' || substr(text, 1, 40) AS item FROM go WHERE NOT grounded
      UNION ALL SELECT book_id, chapter_index, 'length', {_LENGTH_ITEM} FROM fv WHERE length(value) < {_LOW} OR length(value) > {_HIGH}
      UNION ALL SELECT book_id, chapter_index, 'cleared', field FROM oc WHERE outcome <> 'ok')
    SELECT book_id, rule, item, min(chapter_index) AS chapter_index FROM f GROUP BY 1, 2, 3"""
)
def q52_merged_findings(spark, sf_dir):
    """Each finding of a source once, at its first chapter; strict, so that fields without a true quote go."""
    _, findings = validate.validate(_found(spark, sf_dir), _quotes(spark, sf_dir), chapters(spark, sf_dir), strict=True, relations=_told(spark, sf_dir))
    return validate.merged_findings(findings).drop("character")


# ---- cards and model replies


def _folded(spark, sf_dir):
    """All that cards are made of, from events: the fields are the event types, relations their properties."""
    found = observations(spark, sf_dir)
    log = persona.change_log(found)
    quotes = found.select("book_id", "character", "chapter_index", F.lit(0).alias("pos"), "field", F.col("value").alias("text"))
    increments = found.select("book_id", "character", "chapter_index", F.array("value").alias("speech_samples"))
    return {
        "persona": persona.current(found), "relations": persona.relation_rows(_relations(spark, sf_dir)), "timeline": persona.timeline_events(log), "quotes": persona.tagged_quotes(quotes),
        "conflicts": persona.conflicts(log), "samples": persona.samples(increments),
    }


def _cards(spark, sf_dir):
    """Cards of the users; every third has a greeting and a dialogue from its last event."""
    texts = read(spark, sf_dir, "events").groupBy(F.lit("b").alias("book_id"), F.col("user_id").alias("character")).agg(F.max_by("props", "event_id").alias("p"), F.count("*").alias("n"))
    some = texts.where("character % 3 = 0").select(
        "book_id", "character", F.repeat(F.concat("p", F.lit(" ")), (F.col("character") % 40).cast("int")).alias("first_mes"),
        F.concat(F.when(F.col("character") % 2 == 0, "<START>").otherwise(""), "p", F.when(F.col("character") % 5 == 0, "{{char}}").otherwise("")).alias("mes_example"),
    )
    made, findings = flows.build(_folded(spark, sf_dir), cards.DEFAULT_TAG, some)
    return made, findings


_LAST = "SELECT user_id, arg_max(event_type, event_id) AS last, arg_max(props, event_id) AS p FROM events GROUP BY 1"
_CARD = f"""{_LOG}, la AS ({_LAST}), rt AS (SELECT user_id, count(DISTINCT event_type) AS relations, count(*) AS changes FROM events GROUP BY 1), tm AS (SELECT user_id, least(200, count(*)) AS timeline FROM log GROUP BY 1),
    qt AS (SELECT user_id, count(DISTINCT event_type) AS quotes FROM events GROUP BY 1),
    card AS (SELECT CAST(la.user_id AS VARCHAR) AS name, la.user_id AS u, '性格：' || last || chr(10) || '来源：《b》' AS description, last AS personality, relations, changes, timeline, quotes,
      CASE WHEN la.user_id % 3 = 0 THEN repeat(p || ' ', CAST(la.user_id % 40 AS INT)) ELSE '' END AS first_mes,
      CASE WHEN la.user_id % 3 = 0 THEN CASE WHEN la.user_id % 2 = 0 THEN '<START>' ELSE '' END || p || CASE WHEN la.user_id % 5 = 0 THEN '{{{{char}}}}' ELSE '' END ELSE '' END AS mes_example
      FROM la JOIN rt ON rt.user_id = la.user_id JOIN tm ON tm.user_id = la.user_id JOIN qt ON qt.user_id = la.user_id)"""
_CARD = _CARD.replace("{{{{", "{{").replace("}}}}", "}}")


@query(f"WITH {_CARD} SELECT name, description, personality, ['novel'] AS tags, first_mes, mes_example, '1.0' AS character_version, 'b' AS source_book FROM card")
def q41_card_build(spark, sf_dir):
    return _cards(spark, sf_dir)[0].select("name", "description", "personality", "tags", "first_mes", "mes_example", "character_version", "source_book")


@query(
    f"""WITH {_CARD}, rl AS (SELECT user_id, list(event_type ORDER BY f) AS targets, md5(string_agg(d, '|' ORDER BY f)) AS told FROM (SELECT user_id, event_type, min(event_id) AS f, arg_max(props, event_id) AS d FROM events GROUP BY 1, 2) GROUP BY 1)
    SELECT name, 'chara_card_v2' AS spec, '2.0' AS spec_version, personality, '' AS desire, 'novel' AS tag, array_to_string(targets, '|') AS targets, told, timeline, quotes, 'b' AS source_book, 'b' AS book_id FROM card JOIN rl ON rl.user_id = u"""
)
def q42_card_export(spark, sf_dir):
    """The exported JSON, read with JSON paths."""
    made = cards.to_json(_cards(spark, sf_dir)[0])
    get = lambda p: F.get_json_object("json", p)
    own = "$.data.extensions.narrative"
    relations = F.from_json(get(f"{own}.relations"), "array<struct<`from`:string,`to`:string,description:string>>")
    size = lambda p: F.size(F.from_json(get(p), "array<string>")).cast("bigint")
    return made.select(
        "name", get("$.spec").alias("spec"), get("$.spec_version").alias("spec_version"), get("$.data.personality").alias("personality"), get(f"{own}.desire").alias("desire"), get("$.data.tags[0]").alias("tag"),
        F.array_join(F.transform(relations, lambda r: r["to"]), "|").alias("targets"), F.md5(F.array_join(F.transform(relations, lambda r: r["description"]), "|").cast("binary")).alias("told"),
        size(f"{own}.timeline").alias("timeline"), size(f"{own}.extraction_meta.quotes").alias("quotes"), get(f"{own}.source_book").alias("source_book"), get(f"{own}.extraction_meta.book_id").alias("book_id"),
    )


@query(f"WITH {_CARD} SELECT name, description, personality, first_mes, mes_example, relations, changes, timeline, quotes, 'b' AS source_book FROM card")
def q57_card_round_trip(spark, sf_dir):
    """Cards exported and imported again, lists and all."""
    made = cards.to_json(_cards(spark, sf_dir)[0])
    back = cards.import_cards(made.select(F.col("name").alias("id"), "json"))
    n = cards.counters(back.drop("id", "ok"))
    kept = back.select("name", "description", "personality", "first_mes", "mes_example", "source_book")
    counts = n.select("name", *(F.col(a).cast("bigint").alias(b) for a, b in (("relation_count", "relations"), ("relation_evolution_total", "changes"), ("timeline_count", "timeline"), ("quote_count", "quotes"))))
    return kept.join(counts, "name")


@query(
    f"""WITH {_CARD}, f AS (SELECT name, 'empty' AS rule, unnest(['desire', 'flaw', 'secret', 'speech_style']) AS item FROM card
      UNION ALL SELECT name, 'marker', '<START>' FROM card WHERE mes_example <> '' AND NOT contains(mes_example, '<START>')
      UNION ALL SELECT name, 'placeholder', '{{{{user}}}} / {{{{char}}}}' FROM card WHERE mes_example <> '' AND NOT contains(mes_example, '{{{{char}}}}')
      UNION ALL SELECT name, 'length', 'first_mes: ' || CAST(length(first_mes) AS VARCHAR) FROM card WHERE first_mes <> '' AND length(first_mes) NOT BETWEEN 20 AND 300)
    SELECT * FROM f"""
)
def q58_card_findings(spark, sf_dir):
    return _cards(spark, sf_dir)[1]


@query(f"WITH {_CARD} SELECT name, CASE WHEN u % 4 = 1 THEN 'missing' ELSE 'unquoted' END AS rule, 'personality' AS item FROM card WHERE u % 4 IN (1, 2)")
def q59_unquoted_fields(spark, sf_dir):
    """Cards of which some have lost a field to blanks, some the quotes behind it."""
    made = _cards(spark, sf_dir)[0].withColumn("personality", F.when(F.col("name").cast("int") % 4 == 1, " \u3000").otherwise(F.col("personality")))
    quotes = made.where(F.col("name").cast("int") % 4 != 2).select("name", F.lit("personality@ch7").alias("field"))
    return validate.card_findings(made, quotes).where("rule in ('missing', 'unquoted')")


@query(f"WITH {_CARD} SELECT name, length(description) AS description_length, length(personality) AS personality_length, length(first_mes) AS first_mes_length, 1 AS n_tags, relations AS relation_count, changes AS relation_evolution_total, timeline AS timeline_count, quotes AS quote_count, quotes AS speech_sample_count FROM card")
def q60_build_report(spark, sf_dir):
    n = cards.counters(_cards(spark, sf_dir)[0])
    return n.select("name", "description_length", "personality_length", "first_mes_length", "n_tags", "relation_count", "relation_evolution_total", "timeline_count", "quote_count", "speech_sample_count")


def _raw_cards(spark, sf_dir):
    """Turns of conversations as cards in three shapes, as what isn't an object, and as what isn't JSON."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text")
    lit, role, text = F.lit, F.col("role"), F.col("text")
    entry = F.struct(role.alias("key"), text.alias("content"), lit("yes").alias("enabled"), lit("7").alias("insertion_order"), F.col("id").alias("position"))
    own = F.struct(F.struct(text.alias("desire"), F.array(F.struct(role.alias("to"), F.array(text).alias("evolution"))).alias("relations")).alias("narrative"))
    wrapped = F.struct(lit("chara_card_v3").alias("spec"), F.struct(role.alias("name"), text.alias("description"), lit("flat").alias("desire"), F.array(role, lit("x")).alias("tags"), F.struct(F.array(entry, entry).alias("entries")).alias("character_book"), own.alias("extensions")).alias("data"))
    flat = F.struct(lit("chara_card_v2").alias("spec"), role.alias("name"), text.alias("first_message"), role.alias("tags"), F.col("id").alias("description"))
    bare = F.struct(role.alias("name"), lit("").alias("mes_example"), text.alias("example_dialogue"), F.array(entry).alias("character_book"), text.alias("flaw"), lit(True).alias("creator_notes"))
    kind = F.col("id") % 5
    json = F.when(kind == 0, F.to_json(wrapped)).when(kind == 1, F.to_json(flat)).when(kind == 2, F.to_json(bare)).when(kind == 3, F.to_json(F.array(text))).otherwise(F.concat(F.lit("{"), text))
    return rows.select("id", json.alias("json"))


@query(
    """WITH c AS (SELECT conv_id * 100 + turn AS id, (conv_id * 100 + turn) % 5 AS k, role, text FROM conversations)
    SELECT id, k < 3 AS ok, CASE WHEN k < 3 THEN role ELSE '' END AS name, CASE k WHEN 0 THEN text WHEN 1 THEN CAST(id AS VARCHAR) ELSE '' END AS description, CASE k WHEN 1 THEN text ELSE '' END AS first_mes,
      CASE k WHEN 2 THEN text ELSE '' END AS mes_example, CASE k WHEN 0 THEN role || ',x' WHEN 1 THEN role ELSE '' END AS tags, CASE k WHEN 0 THEN text ELSE '' END AS desire, CASE k WHEN 2 THEN text ELSE '' END AS flaw,
      CASE k WHEN 2 THEN 'True' ELSE '' END AS creator_notes, CASE k WHEN 0 THEN role || ',' || role WHEN 2 THEN role ELSE '' END AS keys, CASE k WHEN 0 THEN 14 WHEN 2 THEN 7 ELSE 0 END AS orders,
      CASE k WHEN 0 THEN '{"position":' || CAST(id AS VARCHAR) || '}' END AS lore, CASE k WHEN 0 THEN text END AS evolution FROM c"""
)
def q43_card_import(spark, sf_dir):
    got = cards.import_cards(_raw_cards(spark, sf_dir))
    lore = F.when(F.col("id") % 5 == 0, F.get("lore", F.lit(1)))
    orders = F.coalesce(F.aggregate("character_book", F.lit(0), lambda n, x: n + F.when(x["enabled"], x["insertion_order"]).otherwise(1000)), F.lit(0))
    return got.select(
        "id", "ok", "name", "description", "first_mes", "mes_example", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"), "desire", "flaw", "creator_notes",
        F.coalesce(F.array_join(F.transform("character_book", lambda x: F.array_join(x["keys"], ",")), ","), F.lit("")).alias("keys"), orders.alias("orders"), lore.alias("lore"),
        F.get(F.get("relations", F.lit(0))["evolution"], F.lit(0)).alias("evolution"),
    )


@query("""SELECT doc_id, md5('{keep} ' || lang || ': ' || text) AS digest FROM documents""")
def q44_prompt_render(spark, sf_dir):
    made = T.render(F.lit("{keep} {lang}: {text}"), {"lang": F.col("lang"), "text": F.col("text")})
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(made.cast("binary")).alias("digest"))


def _replies(spark, sf_dir):
    """Replies that list a document's names: under a key, fenced and bare, under another key, under none, damaged."""
    found = F.regexp_extract_all("text", F.lit(TOKEN), 0)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.transform(found, lambda x: F.concat(F.lit("「"), x, F.lit(" "))).alias("f"))
    listed, kind = F.to_json("f"), F.col("doc_id") % 5
    reply = F.when(kind == 0, F.concat(F.lit('{"characters": '), listed, F.lit("}"))).when(kind == 1, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
    return rows.select("doc_id", reply.when(kind == 2, F.concat(F.lit('{"names": '), listed, F.lit("}"))).when(kind == 3, F.concat(F.lit('{"other": '), listed, F.lit("}"))).otherwise(F.concat(F.lit("names: "), listed)).alias("reply"))


_SEEN = f"""f AS (SELECT doc_id, generate_subscripts(f, 1) AS o, unnest(f) AS name FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS f FROM documents)), g AS (SELECT doc_id, name, min(o) AS o FROM f GROUP BY 1, 2)"""


@query(f"WITH {_SEEN}, h AS (SELECT doc_id, string_agg(name, '|' ORDER BY o) AS names FROM g GROUP BY 1) SELECT d.doc_id, CASE WHEN d.doc_id % 5 < 3 THEN coalesce(names, '') ELSE '' END AS names FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id")
def q45_parse_names(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", F.array_join(model.names_of("reply"), "|").alias("names"))


@query(
    f"""WITH {_SEEN}, h AS (SELECT doc_id, list(name ORDER BY o) AS n FROM g GROUP BY 1) SELECT doc_id, n[1] AS main, array_to_string(n[2:], '|') AS aliases, CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE '' END AS reason FROM h WHERE len(n) > 1 AND doc_id % 3 < 2"""
)
def q61_parse_alias_groups(spark, sf_dir):
    """The names of a document as one group, its main name among the aliases too, beside a group without a main name and
    one without aliases; under a key, bare, or damaged."""
    found = F.regexp_extract_all("text", F.lit(TOKEN), 0)
    rows = read(spark, sf_dir, "documents").select("doc_id", found.alias("f")).where(F.size("f") > 0)
    group = lambda main, names: F.struct(main.alias("main"), names.alias("aliases"), F.when(F.col("doc_id") % 2 == 0, "r").alias("reason"))
    none = F.array().cast("array<string>")
    listed = F.to_json(F.array(group(F.lit(" "), F.col("f")), group(F.get("f", F.lit(0)), F.col("f")), group(F.lit("alone"), none)))
    kind = F.col("doc_id") % 3
    reply = F.when(kind == 0, F.concat(F.lit('{"groups": '), listed, F.lit("}"))).when(kind == 1, F.concat(F.lit("```\n"), listed, F.lit("```"))).otherwise(F.concat(listed, F.lit("]")))
    parsed = rows.select("doc_id", F.inline(model.alias_groups_of(reply)))
    return parsed.select("doc_id", "main", F.array_join("aliases", "|").alias("aliases"), "reason")


@query(
    """SELECT event_id, event_id % 4 < 3 AS ok, CASE WHEN event_id % 4 < 3 THEN event_type END AS personality, CASE WHEN event_id % 4 < 3 THEN 1 END AS relations, CASE WHEN event_id % 4 < 3 THEN props END AS change,
    CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS samples FROM events"""
)
def q62_parse_persona(spark, sf_dir):
    """Events as replies: lists as they should be, a lone object and text in their place, samples missing, no object."""
    e, kind = read(spark, sf_dir, "events"), F.col("event_id") % 4
    told = F.struct(F.lit("t").alias("target"), F.col("props").alias("change"), F.lit(1).alias("unknown"))
    full = F.struct(F.col("event_type").alias("personality"), F.array(told).alias("relationships"), F.array(F.lit("a"), F.lit("b")).alias("speech_samples"))
    lone = F.struct(F.col("event_type").alias("personality"), told.alias("relationships"), F.lit("a").alias("speech_samples"))
    less = F.struct(F.col("event_type").alias("personality"), F.array(told).alias("relationships"))
    reply = F.when(kind == 0, F.to_json(full)).when(kind == 1, F.concat(F.lit("```json\n"), F.to_json(lone), F.lit("\n```"))).when(kind == 2, F.to_json(less)).otherwise(F.to_json(F.array("props")))
    p = e.select("event_id", model.persona_of(reply).alias("p"))
    has = F.col("p").isNotNull()
    return p.select(
        "event_id", has.alias("ok"), "p.personality", F.when(has, F.size("p.relationships")).alias("relations"), F.get("p.relationships", F.lit(0))["change"].alias("change"), F.when(has, F.size("p.speech_samples")).alias("samples")
    )


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN user_id ELSE 0 END AS cached FROM events")
def q63_cached_tokens(spark, sf_dir):
    e, kind, n = read(spark, sf_dir, "events"), F.col("event_id") % 5, F.col("user_id").cast("string")
    usage = F.when(kind == 0, F.format_string('{"prompt_tokens_details": {"cached_tokens": %s}, "cache_read_input_tokens": 1}', n)).when(kind == 1, F.format_string('{"prompt_cache_hit_tokens": %s}', n))
    usage = usage.when(kind == 2, F.format_string('{"cache_read_input_tokens": %s}', n)).when(kind == 3, F.lit("{}")).otherwise(F.lit("none"))
    return e.select("event_id", model.cached_tokens(usage).alias("cached"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '{TOKEN}') AS f FROM conversations), c AS (SELECT conv_id, count(*) AS n, sum(len(f)) AS names, string_agg(array_to_string(f, ','), '|' ORDER BY turn) AS all_names, arg_min(array_to_string(f, ','), turn) AS head FROM t GROUP BY 1)
    SELECT conv_id AS chapter_index, CASE conv_id % 3 WHEN 0 THEN n ELSE 1 END AS chunks, CASE conv_id % 3 WHEN 0 THEN md5(all_names) WHEN 1 THEN md5(head) ELSE md5('') END AS digest FROM c"""
)
def q64_chunk_shapes(spark, sf_dir):
    """Stored names as a list of lists, as the flat list of one piece, and as an empty list."""
    rows, kind = _cache(spark, sf_dir), F.col("chapter_index") % 3
    parts = F.when(kind == 0, F.to_json("chunks")).when(kind == 1, F.to_json(F.get("chunks", F.lit(0)))).otherwise(F.lit("[]"))
    got = rows.select("chapter_index", files.canonical_chunks(parts).alias("c"))
    return got.select("chapter_index", F.size("c").alias("chunks"), F.md5(F.array_join(F.transform("c", lambda x: F.array_join(x, ",")), "|").cast("binary")).alias("digest"))


_ADS = " OR ".join(f"regexp_matches(x, '{p}')" for p in (r"(?i)^[ \t　]*(?:https?://|www\.)\S+[ \t　]*$", *rules.AD_PATTERNS))
#: Lines of the kinds that sites add, and some that only look like them; a document's lines are dealt over them.
SITE_LINES = ("", "本站域名", "下一章", "　书签", "求 月票吧", "订阅一下", "（全文完）", "https://x.y/z", "他说 www.x.y 不好", "月票的故事。", "手机阅读", "在线阅读", "夹着书签的书")
_SITED = "list_transform(string_split(text, chr(10)), lambda x, i: CASE (length(x) + i - 1) % 39 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(SITE_LINES) if x) + " ELSE x || '　' END)"
_TIDY = rf"trim(regexp_replace(list_aggregate(list_filter(list_transform({_SITED}, lambda x: regexp_replace(x, '[\s　]+$', '')), lambda x: NOT ({_ADS})), 'string_agg', chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' 　' || chr(10) || chr(9))"


def _sited(text):
    """A text in which some lines are those of a site."""
    line = F.array(*(F.lit(x) for x in SITE_LINES))

    def one(x, i):
        k = (F.length(x) + i) % 39
        return F.when((k > 0) & (k < len(SITE_LINES)), F.get(line, k)).otherwise(F.concat(x, F.lit("　")))

    return F.array_join(F.transform(F.split(text, "\n", -1), one), "\n")


@query(f"SELECT doc_id, md5(coalesce({_TIDY}, '')) AS digest, length(coalesce({_TIDY}, '')) AS n FROM documents")
def q65_site_lines(spark, sf_dir):
    """The rules for lines that sites add, all of them, over documents that have such lines."""
    text = T.clean_text(_sited(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.length(text).cast("bigint").alias("n"))


@query(
    f"""WITH t AS (SELECT doc_id, coalesce({_TIDY}, '') AS t FROM documents)
    SELECT CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '_名' ELSE '' END AS book_id, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' ELSE 'gb18030' END AS encoding, length(t) AS char_count, md5(t) AS digest FROM t"""
)
def q46_decode(spark, sf_dir):
    """Documents as files in five encodings: written by one library, read by the engine."""

    @F.pandas_udf("binary")
    def written(kind: pd.Series, text: pd.Series) -> pd.Series:
        codecs = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "gb18030")
        marks = (b"", b"", b"\xff\xfe", b"\xfe\xff", b"")
        return pd.Series([marks[k] + (t + ("漢" if k == 4 else "")).encode(codecs[k]) for k, t in zip(kind, text)])

    rows = read(spark, sf_dir, "documents").withColumn("text", _sited(F.col("text")))
    tail = F.when(F.col("doc_id") % 5 == 4, "\n最新章节").otherwise("")  # such files hold what no valid UTF-8 can look like
    name = F.concat(F.lit("/in/《"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, " 名").otherwise(""), F.lit("》.txt"))
    raw = rows.select(name.alias("path"), written((F.col("doc_id") % 5).cast("int"), F.concat("text", tail)).alias("content"))
    return files.decoded(raw).select("book_id", "encoding", F.col("char_count").cast("bigint").alias("char_count"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS f, text FROM documents)
    SELECT doc_id, length(text) + length(regexp_replace(text, '[\\x00-\\x{{2E80}}]', '', 'g')) AS width, 'mem_' || substr(sha1(CAST(doc_id AS VARCHAR) || '␟' || text), 1, 16) AS id, len(f) AS names FROM m"""
)
def q47_scalar_functions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", T.display_width("text").alias("width"), T.content_id("mem_", F.col("doc_id").cast("string"), "text").alias("id"), F.size(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("names")
    )


@query(r"SELECT conv_id, turn, true AS ok, length('Names in: ' || text) // 4 AS prompt_tokens, len(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]{3,}\b'))) AS names FROM conversations")
def q48_model_scan(spark, sf_dir):
    """One call of the injected model a conversation turn; here the deterministic stand-in."""
    prompts = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Names in: "), "text").alias("prompt"))
    called = model.complete_rows(prompts, model.names_stub, retries=0)
    return called.select("conv_id", "turn", "ok", "prompt_tokens", (F.size(model.names_of("content")) - 1).alias("names"))


# ---- passages, sources and sinks


@query(
    f"""WITH d AS (SELECT source, doc_id, split_part(text, chr(10), 1) AS title, {_PARAS} AS p FROM documents),
    b AS (SELECT source AS book_id, doc_id AS chapter_index, list_filter(list_transform(p, lambda x: trim(list_aggregate(list_filter(string_split(x, chr(10)), lambda y: trim(y, ' ' || chr(9)) <> trim(title, ' ' || chr(9))), 'string_agg', chr(10)), ' ' || chr(10) || chr(9))), lambda x: coalesce(x, '') <> '') AS p FROM d),
    e AS (SELECT book_id, chapter_index, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS passage FROM b)
    SELECT book_id, chapter_index, pos, md5(passage) AS digest FROM e WHERE {" OR ".join(f"contains(passage, '{n}')" for n in ALIASES)}"""
)
def q66_passages_without_title(spark, sf_dir):
    """The paragraphs with a name, without lines that repeat the title, here the first line."""
    rows = chapters(spark, sf_dir).withColumn("title", F.split_part("content", F.lit("\n"), F.lit(1)))
    return segment.passages(rows, ALIASES, keep_title=False).select("book_id", "chapter_index", "pos", F.md5(F.col("passage").cast("binary")).alias("digest"))


@query(f"WITH {_MENTIONS}, {_RANKED}, h AS (SELECT r.book_id, r.name, bool_or(contains(text, r.name || '.')) AS has FROM r JOIN documents d ON d.source = r.book_id WHERE rank <= 15 GROUP BY 1, 2) SELECT book_id, count(*) FILTER (WHERE has) AS kept, count(*) FILTER (WHERE NOT has) AS dropped FROM h GROUP BY 1")
def q67_candidates_with_contexts(spark, sf_dir):
    """Candidates that go to the model, those with a context, here one that ends a sentence; and those that don't."""
    top = _ranked(spark, sf_dir, 15).select("book_id", "name")
    ended = top.select("book_id", F.concat("name", F.lit(".")).alias("name"))  # so that the first contexts are such ends
    said = names.contexts(ended, chapters(spark, sf_dir), 3, F.regexp_extract_all("content", F.lit(TOKEN + r"\."), 0))
    ends = said.groupBy("book_id", F.rtrim("name", F.lit(".")).alias("name")).agg(F.collect_list("sentence").alias("contexts"))
    kept, dropped = aliases.with_contexts(top.join(ends, ["book_id", "name"], "left"))
    count = lambda d, c: d.groupBy("book_id").agg(F.count("*").alias(c))
    return top.select("book_id").distinct().join(count(kept, "kept"), "book_id", "left").join(count(dropped, "dropped"), "book_id", "left").fillna(0)


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for what a query writes: shared where the session names one, else of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="narrative-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    """WITH c AS (SELECT source AS book_id, doc_id AS chapter_index, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE lang END AS fingerprint FROM documents WHERE source <> 'src1' OR doc_id % 2 = 0)
    SELECT book_id, count(*) AS n, count(*) FILTER (WHERE fingerprint = 'new') AS renewed, md5(string_agg(fingerprint, '|' ORDER BY chapter_index)) AS digest FROM c GROUP BY 1"""
)
def q68_repository(spark, sf_dir):
    """Chapter caches saved, some saved again, some deleted, and read back."""
    store = Catalog(spark, _folder(spark, "catalog"))
    rows = chapters(spark, sf_dir).select("book_id", "chapter_index", F.col("title").alias("fingerprint"), F.array(F.array("title")).alias("chunks"))
    store.save("chapter_names", rows)
    store.save("chapter_names", rows.where("chapter_index % 7 = 0").withColumn("fingerprint", F.lit("new")))
    gone = rows.where("book_id = 'src1' and chapter_index % 2 = 1").select("book_id", "chapter_index")
    store.delete_units("chapter_names", gone)
    got = store.load("chapter_names")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "fingerprint"))), lambda x: x["fingerprint"])
    return got.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("fingerprint") == "new").alias("renewed"), F.md5(F.array_join(ordered, "|").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 4 = 0")
def q69_json_lines(spark, sf_dir):
    """Documents written as JSON lines, damaged, as lists, or blank by turns; what can be read comes back."""
    path, kind = _folder(spark, "lines"), F.col("doc_id") % 4
    line = F.to_json(F.struct("doc_id", "text", F.lit(1).alias("unknown")))
    damaged = F.when(kind == 0, line).when(kind == 1, F.substring(line, F.lit(1), F.length(line) - 3)).when(kind == 2, F.to_json(F.array("text"))).otherwise(F.lit(""))
    read(spark, sf_dir, "documents").select(damaged.alias("value")).write.text(path)
    return files.read_json_lines(spark, path, "doc_id bigint, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def q70_complete_texts(spark, sf_dir):
    """Downloads with an end marker, without one, and cut inside a character."""
    kind, text = F.col("doc_id") % 3, F.col("text")
    content = F.when(kind == 0, F.concat(text, F.lit("\n*** END ***")).cast("binary")).when(kind == 1, text.cast("binary")).otherwise(F.concat(F.concat(text, F.lit("*** END ***")).cast("binary"), F.unhex(F.lit("E6BC"))))
    raw = read(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return files.complete_texts(raw, "*** END ***").select("doc_id")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS card_id FROM events WHERE user_id % 5 <> 0")
def q71_card_repository(spark, sf_dir):
    """Cards saved twice under their names, a fifth deleted, listed by id."""
    store = Catalog(spark, _folder(spark, "cards"))
    made = persona.current(observations(spark, sf_dir))
    for _ in range(2):
        store.save("cards", cards.build(made))
    store.delete_units("cards", made.where("character % 5 = 0").select(F.col("character").cast("string").alias("card_id")))
    return store.ids("cards")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, name tokens, the fifteen top names of each source and their first sentences."""
    texts = chapters(spark, sf_dir).withColumn("content", T.clean_text("content", rules.LATIN_JUNK))
    top = names.rank(names.name_tokens(texts, TOKEN), 15)
    found = F.regexp_extract_all("content", F.lit("[^.!?\n]+[.!?]?"), 0)
    said = names.contexts(top, texts, 3, F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) >= 4))
    quotes = said.groupBy("book_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"]), " / ").alias("contexts"))
    return top.join(quotes, ["book_id", "name"], "left").select("book_id", "rank", "name", "chapter_count", "mentions", "contexts")

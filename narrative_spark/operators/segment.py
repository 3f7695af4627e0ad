"""Cleaning, segmentation and chunking of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def clean(books: DataFrame, patterns: tuple[str, ...] = rules.AD_PATTERNS) -> DataFrame:
    return books.withColumn("text", T.clean_text("text", patterns))


def lines(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _joined(rows: Column) -> Column:
    """Lines of a segment in order. Sorting within the group keeps the result independent of the shuffle."""
    return T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n"))


def by_headings(books: DataFrame, title: Column | None = None, preface: int = rules.HEADING_PREFACE) -> DataFrame:
    """``(book_id, chapter_index, title, content)``: a segment is the lines after a heading up to the next.

    Text before the first heading is a chapter of its own if it has ``preface`` characters. Books without a heading
    have no rows.
    """
    title = T.chapter_title("line") if title is None else title
    in_order = W.partitionBy("book_id").orderBy("line_no")
    flagged = lines(books).withColumn("title", title).withColumn("seg", F.sum(F.col("title").isNotNull().cast("int")).over(in_order))
    body = F.when(F.col("title").isNull(), F.struct("line_no", "line"))
    segments = flagged.groupBy("book_id", "seg").agg(F.max("title").alias("title"), _joined(body).alias("content"))
    has = segments.where("seg > 0").select("book_id").distinct()
    kept = segments.join(has, "book_id", "left_semi").where((F.col("seg") > 0) | (F.length("content") >= preface))
    return renumbered(kept.withColumn("title", F.coalesce("title", F.lit(rules.PREFACE_TITLE))), "seg")


def by_separators(books: DataFrame, longest: int = rules.SEPARATOR_TITLE_LENGTH, preface: int = rules.SEPARATOR_PREFACE) -> DataFrame:
    """Segments between separator lines; the short line above a separator is the title of what follows it.

    A separator without one has a number as title. Segments without text go; books without a separator have no rows.
    """
    in_order = W.partitionBy("book_id").orderBy("line_no")
    above = in_order.rowsBetween(W.unboundedPreceding, -1)
    flat = lines(books).withColumn("line", T.strip("line")).withColumn("sep", T.is_separator("line"))
    last = F.last(F.when(F.col("line") != "", F.struct("line_no", "line", "sep")), ignorenulls=True).over(above)
    flat = flat.withColumn("above", last)
    titled = F.col("sep") & F.col("above").isNotNull() & ~F.col("above.sep") & (F.length("above.line") <= longest)
    flat = flat.withColumn("title", F.when(titled, F.col("above.line"))).withColumn("title_line", F.when(titled, F.col("above.line_no")))
    # a title line belongs to the separator below it: it ends the segment before. From the last line up, the frame grows
    # by a line at a time, where one that ends below would be read again for each line
    below = W.partitionBy("book_id").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1)
    next_title = F.last(F.when(F.col("sep"), F.struct("title_line")), ignorenulls=True).over(below)
    flat = flat.withColumn("seg", F.sum(F.col("sep").cast("int")).over(in_order)).withColumn("next", next_title["title_line"])
    body = F.when(~F.col("sep") & (F.col("next").isNull() | (F.col("line_no") < F.col("next"))), F.struct("line_no", "line"))
    segments = flat.groupBy("book_id", "seg").agg(F.max("title").alias("title"), _joined(body).alias("content"), F.max("sep").alias("has"))
    found = segments.where("seg > 0").select("book_id").distinct()
    kept = segments.join(found, "book_id", "left_semi").where(
        ((F.col("seg") > 0) & (F.col("content") != "")) | ((F.col("seg") == 0) & (F.length("content") >= preface))
    )
    name = F.when(F.col("seg") == 0, F.lit(rules.PREFACE_TITLE)).otherwise(F.coalesce("title", F.concat(F.lit("第"), F.col("seg").cast("string"), F.lit("节"))))
    return renumbered(kept.withColumn("title", name), "seg")


def renumbered(segments: DataFrame, *order: str) -> DataFrame:
    index = F.row_number().over(W.partitionBy("book_id").orderBy(*order)) - 1
    return segments.select("book_id", index.alias("chapter_index"), "title", "content")


def by_length(books: DataFrame, length: int = rules.FALLBACK_LENGTH) -> DataFrame:
    """Fixed-length chapters, cut behind sentence ends."""
    pieces = books.select("book_id", F.posexplode(T.chunks("text", length)).alias("chapter_index", "content"))
    return pieces.select("book_id", "chapter_index", F.concat(F.lit("第"), (F.col("chapter_index") + 1).cast("string"), F.lit("节")).alias("title"), "content")


def _separated(lines: Column, longest: int = rules.SEPARATOR_TITLE_LENGTH, preface: int = rules.SEPARATOR_PREFACE) -> Column:
    """How many chapters :func:`by_separators` would make of an array of stripped lines, in one pass over it.

    A part between separators has text if a line is left once the title of the next part is taken from its end.
    """
    first = F.array_position(F.transform(lines, lambda x: T.is_separator(x)), F.lit(True))
    state = F.struct(F.lit(0).alias("done"), F.lit(0).alias("held"), F.lit(0).alias("last"))

    def add(acc: Column, line: Column) -> Column:
        sep = T.is_separator(line)
        full = (acc["held"] > 1) | ((acc["held"] == 1) & (acc["last"] > longest))
        return F.struct(
            F.when(sep & full, acc["done"] + 1).otherwise(acc["done"]).alias("done"),
            F.when(sep, 0).when(line != "", acc["held"] + 1).otherwise(acc["held"]).alias("held"),
            F.when(line != "", F.length(line)).otherwise(acc["last"]).alias("last"),
        )

    rest = F.slice(lines, first.cast("int") + 1, F.greatest(F.lit(0), F.size(lines) - first.cast("int")))
    parts = F.aggregate(rest, state, add, lambda acc: acc["done"] + F.when(acc["held"] > 0, 1).otherwise(0))
    head = T.strip(F.array_join(F.slice(lines, 1, first.cast("int") - 1), "\n"))
    title = F.element_at(F.split(head, "\n", -1), -1)
    body = F.when(F.length(title) <= longest, T.strip(F.substring(head, F.lit(1), F.length(head) - F.length(title)))).otherwise(head)
    return F.when(first == 0, 0).otherwise(parts + F.when(F.length(body) >= preface, 1).otherwise(0))


def marker_counts(books: DataFrame) -> DataFrame:
    """``(book_id, headings, separators, segments, plan)``: the plan that a book's markers call for, from its own row.

    Separators win if they make over twice as many chapters as there are headings, or any where there is no heading.
    Headings that leave all chapters empty don't count: such a book is cut by length.
    """
    return books.select("book_id", *_plan(F.col("text")))


def _plan(text: Column) -> list[Column]:
    stripped = F.transform(F.split(text, "\n", -1), T.strip)
    heads = F.size(F.filter(stripped, lambda x: T.chapter_title(x).isNotNull()))
    seps = F.size(F.filter(stripped, lambda x: T.is_separator(x)))
    # so many separators make a chapter more at most: others needn't be cut to be counted
    segments = F.when((seps > 0) & (seps + 1 > 2 * heads), _separated(stripped)).otherwise(0)
    first = F.array_position(F.transform(stripped, lambda x: T.chapter_title(x).isNotNull()), F.lit(True)).cast("int")
    preface = T.strip(F.array_join(F.slice(stripped, 1, F.greatest(F.lit(0), first - 1)), "\n"))
    said = F.exists(F.slice(stripped, F.greatest(F.lit(1), first), F.size(stripped)), lambda x: (x != "") & T.chapter_title(x).isNull())
    headed = (heads > 0) & (said | (F.length(preface) >= rules.HEADING_PREFACE))
    plan = F.when((segments > 0) & (segments > 2 * heads), "separators").when(headed, "headings").otherwise("length")
    return [heads.alias("headings"), seps.alias("separators"), segments.alias("segments"), plan.alias("plan")]


def segment(books: DataFrame, length: int = rules.FALLBACK_LENGTH) -> DataFrame:
    """Chapters by the plan of each book, which is a column of its row: separators, headings, or else fixed lengths."""
    planned = books.select("book_id", "text", _plan(F.col("text"))[-1])
    pick = lambda p: planned.where(F.col("plan") == p).select("book_id", "text")
    return by_headings(pick("headings")).unionByName(by_separators(pick("separators"))).unionByName(by_length(pick("length"), length))


def split_long(chapters: DataFrame, longest: int = rules.CHAPTER_LENGTH) -> DataFrame:
    """Chapters over ``longest`` in parts titled ``title（i/n）``, all renumbered; others keep their content as it is.

    Numbers are running sums of the chapters' counts of parts, joined back by chapter: no text is sorted.
    """
    parts = F.when(F.length("content") > longest, T.chunks("content", longest)).otherwise(F.array("content"))
    cut = chapters.select("book_id", "chapter_index", "title", parts.alias("parts"))
    before = W.partitionBy("book_id").orderBy("chapter_index").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.select("book_id", "chapter_index", F.size("parts").alias("n"))
    bases = counts.select("book_id", "chapter_index", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("base"))
    each = cut.join(bases, ["book_id", "chapter_index"]).select("book_id", "title", "base", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "content"))
    title = F.when(F.col("n") > 1, F.concat("title", F.lit("（"), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("）"))).otherwise(F.col("title"))
    return each.select("book_id", (F.col("base") + F.col("part")).alias("chapter_index"), title.alias("title"), "content")


def blocks(content: Column | str, title: Column | str, keep_title: bool = True, longest: int = 1200) -> Column:
    """The paragraphs of a chapter, without lines that repeat its title unless those are kept."""
    found = T.paragraphs(content, longest)
    if keep_title:
        return found
    own = T.strip(F.coalesce(T.col(title), F.lit("")))
    drop = lambda b: T.strip(F.array_join(F.filter(F.split(b, "\n"), lambda x: T.strip(x) != own), "\n"))
    return F.filter(F.transform(found, drop), lambda x: x != "")


def passages(chapters: DataFrame, names: list[str], keep_title: bool = True, longest: int = 1200) -> DataFrame:
    """``(book_id, chapter_index, pos, passage)``: the paragraphs that hold one of the names, in order; no names, none."""
    held = F.lit(False)
    exploded = chapters.select("book_id", "chapter_index", F.posexplode(blocks("content", "title", keep_title, longest)).alias("pos", "passage"))
    for n in filter(None, names):
        held = held | F.contains("passage", F.lit(n))
    return exploded.where(held)


def batches(texts: Column | str, most: int = 5000) -> Column:
    """Ordered packing of an array of passages into batches of at most ``most`` characters, joined by a blank line.

    A longer passage is cut: full pieces are batches of their own and its rest goes on as a passage.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, passage: Column) -> Column:
        full = F.floor((F.length(passage) - 1) / most).cast("int")
        pieces = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.substring(passage, i * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))
        rest = F.substring(passage, full * most + 1, F.lit(most))
        flush = (acc["now"] != "") & ((full > 0) | (F.length(acc["now"]) + 2 + F.length(rest) > most))
        done = F.concat(acc["done"], F.when(flush, F.array(acc["now"])).otherwise(F.array().cast("array<string>")), pieces)
        now = F.when((acc["now"] == "") | flush, rest).otherwise(F.concat_ws("\n\n", acc["now"], rest))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(texts, start, add, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["now"])), lambda x: x != ""))

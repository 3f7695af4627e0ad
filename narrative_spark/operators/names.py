"""Names per chapter, the scan cache, script variants, ranking and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

TOKEN = r"\b\p{Lu}\p{Ll}{3,}\b"


def name_tokens(chapters: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """``(book_id, chapter_index, chunk_no, pos, name)`` for texts in which names are capitalised words."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 0))
    # an inner explode would first ask whether there are names, and so search each text twice
    rows = chapters.select("book_id", "chapter_index", F.lit(0).alias("chunk_no"), F.posexplode_outer(found).alias("pos", "name"))
    return rows.where("pos is not null")


def with_fingerprint(chapters: DataFrame, limit: int = 6000) -> DataFrame:
    """The chapter's pieces for a model call and their fingerprint."""
    pieces = F.when(F.length("content") <= limit, F.array("content")).otherwise(T.chunks("content", limit))
    return chapters.withColumn("pieces", pieces).withColumn("fingerprint", T.fingerprint("title", "pieces"))


KEY = ["book_id", "chapter_index", "fingerprint"]


def cache_misses(chapters: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Chapters that have to be scanned: those whose fingerprint the cache lacks."""
    return chapters if force else chapters.join(cache.select(*KEY), KEY, "left_anti")


def cache_hits(chapters: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.join(chapters.select(*KEY), KEY, "left_semi")


def chapter_names(cache: DataFrame) -> DataFrame:
    """The names of a chapter over its chunks, first seen first."""
    return cache.select("book_id", "chapter_index", F.array_distinct(F.flatten("chunks")).alias("names"))


def mentions(cache: DataFrame) -> DataFrame:
    each = cache.select("book_id", "chapter_index", F.posexplode("chunks").alias("chunk_no", "names"))
    return each.select("book_id", "chapter_index", "chunk_no", F.posexplode("names").alias("pos", "name"))


def rank(found: DataFrame, top: int = 15) -> DataFrame:
    """``(book_id, rank, name, chapter_count, mentions, chapter_indexes)`` by chapters, then mentions, then name."""
    stats = found.groupBy("book_id", "name").agg(
        F.count_distinct("chapter_index").alias("chapter_count"), F.count("*").alias("mentions"), F.sort_array(F.collect_set("chapter_index")).alias("chapter_indexes")
    )
    order = W.partitionBy("book_id").orderBy(F.desc("chapter_count"), F.desc("mentions"), "name")
    return stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def contexts(names: DataFrame, chapters: DataFrame, limit: int = 3, cut: Column | None = None) -> DataFrame:
    """``(book_id, name, k, sentence)``: the first sentences with a name, in chapter order.

    A book's few names come beside its chapters as an array; a sentence leaves its chapter only with the names it holds.
    """
    cut = T.sentences("content") if cut is None else cut
    listed = names.groupBy("book_id").agg(F.collect_set("name").alias("listed"))
    said = chapters.join(listed, "book_id").select("book_id", "chapter_index", "listed", F.posexplode(cut).alias("pos", "sentence"))
    held = said.withColumn("name", F.explode(F.filter("listed", lambda n: F.contains("sentence", n))))
    k = F.row_number().over(W.partitionBy("book_id", "name").orderBy("chapter_index", "pos"))
    return held.withColumn("k", k).where(F.col("k") <= limit).select("book_id", "name", "k", "sentence")


def source_forms(names: DataFrame, chapters: DataFrame) -> DataFrame:
    """``(book_id, name, form)``: the spelling that the book has: the name, its traditional or its simplified form.

    Names are held against one chapter at a time, and what chapters hold is put together by name: no book is gathered.
    """
    each = names.select("book_id", "name").distinct().select("book_id", F.struct("name", T.traditional("name").alias("t"), T.simplified("name").alias("s")).alias("n"))
    listed = each.groupBy("book_id").agg(F.collect_list("n").alias("listed"))
    has = F.transform("listed", lambda n: F.struct(n["name"].alias("name"), *(F.contains("content", n[c]).alias(f"has_{c}") for c in ("name", "t", "s"))))
    held = chapters.join(listed, "book_id").select("book_id", F.explode(F.filter(has, lambda x: x["has_name"] | x["has_t"] | x["has_s"])).alias("x"))
    flags = held.groupBy("book_id", F.col("x.name").alias("name")).agg(*(F.max(F.col(f"x.has_{c}").cast("int")).alias(c + "_") for c in ("name", "t", "s")))
    known = each.select("book_id", "n.*").join(flags, ["book_id", "name"], "left")
    has = lambda c: F.col(c + "_") == 1
    return known.select("book_id", "name", F.when(has("name"), F.col("name")).when(has("t"), F.col("t")).when(has("s"), F.col("s")).otherwise(F.col("name")).alias("form"))


def renamed(forms: DataFrame) -> DataFrame:
    """The names whose spelling the source changed, with that spelling."""
    return forms.where("name <> form")


def normalised(found: DataFrame, forms: DataFrame) -> DataFrame:
    """Mentions under the spelling of the source."""
    return found.join(forms, ["book_id", "name"], "left").withColumn("name", F.coalesce("form", "name")).drop("form")


def context_lines(quotes: Column) -> Column:
    marks = F.array(*map(F.lit, ("①", "②", "③")))
    return F.array_join(F.transform(F.slice(quotes, 1, 3), lambda q, i: F.concat(F.element_at(marks, i + 1), q)), "")

"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import Scratch, free_names, narrow_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased: all of ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A table of so many rows at most is broadcast. Beyond it, the words of a document meet it in one of ``SALTS`` copies,
#: so that no frequent word is one task's.
SMALL, SALTS = 500_000, 32
#: Bits of the filter that keeps documents without candidates out of a join: a table of 2^20 rows of words at most. Where
#: that is too few, the filter is left out.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def split_words(text: Column) -> Column:
    """The words of a text; the first and the last element can be empty, where the text begins or ends otherwise."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN)


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, ipos, term, n)``: the words of test items. Items without words, null ones too, have no rows."""
    words = items.select("item_id", F.array_remove(split_words(F.col("text")), "").alias("w")).distinct()
    words = words.withColumn("item", F.xxhash64("item_id", "w"))  # rows that repeat an id with another text stay apart
    return words.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "term"))


def by_word(rows: DataFrame, table: DataFrame, word: str, n: int, how: str = "inner") -> DataFrame:
    """Join ``rows``, which have a ``rid``, to a table of ``n`` rows with a column ``term``, on ``word`` and that term."""
    if n <= SMALL:
        return rows.join(F.broadcast(table), F.col(word) == F.col("term"), how)
    copies = table.withColumn("salt_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt_r", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, (F.col(word) == F.col("term")) & (F.col("salt_r") == F.col("salt_t")), how).drop("salt_r", "salt_t")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``(rid, doc_id, n_words, pos, term)`` of the vocabulary's terms, plus each row's first position.

    The index is partitioned by document: postings are written where a text is read, without a shuffle of the text.
    ``rid`` is the row's own number, so that rows that repeat an id stay apart. Only a first position has the document's
    id and number of words; one of another term has a null term.
    """
    words = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", split_words(F.col("text")).alias("w"))
    n = F.size("w") - F.when(F.col("w")[0] == "", 1).otherwise(0) - F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    each = words.select("rid", "doc_id", n.cast("bigint").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    known = vocabulary.select("term").distinct()
    found = by_word(each, known, "word", known.count(), "left").where(F.col("term").isNotNull() | (F.col("pos") == 0))
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    return found.select("rid", first("doc_id"), first("n_words"), "pos", "term")


def plan_windows(terms: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """``(item, item_id, j, len, a, term_a, b, term_b)``: each window with the places of its two rarest terms.

    Terms that the corpus lacks count 0, so their windows find no posting. A window of one word has no second term.
    """
    terms = terms.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    length = F.least("n", F.lit(width))
    starts = terms.withColumn("len", length).withColumn(
        "j", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("len") + 1), F.least("ipos", F.col("n") - F.col("len"))))
    )
    rank = F.row_number().over(W.partitionBy("item", "j").orderBy("count", "ipos"))
    two = starts.withColumn("rank", rank).where("rank <= 2")
    place = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return two.groupBy("item", "item_id", "j", "len").agg(
        place(1, "ipos").alias("a"), place(1, "term").alias("term_a"), place(2, "ipos").alias("b"), place(2, "term").alias("term_b")
    )


def near_rows(postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Postings of rows that may have a candidate: a filter of hashed bits, as a table of 64-bit words.

    The filter has 128 bits or more for each row with a candidate, counted before, as long as it can be broadcast, so that
    it lets hardly any of the other rows through; those find no candidate in the join. Where four bits a row would be too
    many, nothing is filtered.
    """
    n = candidates.agg(F.approx_count_distinct("rid")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (128 * n).bit_length()))
    if 4 * n > bits:
        return postings
    place = F.xxhash64("rid").bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftrightunsigned(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    words = candidates.select(word.alias("word"), F.expr("shiftleft(1L, cast(xxhash64(rid) & 63 as int))").alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
    return postings.withColumn("word", word).join(F.broadcast(words), "word").where(F.getbit("bits", bit) == 1).select(*postings.columns)


def phrase_matches(scratch: Scratch, index: DataFrame, terms: DataFrame, windows: DataFrame) -> DataFrame:
    """``(rid, item_id, start, len)`` of every occurrence of every window, from the postings alone.

    Lists are taken from the rarest term of a window: its positions less its offset are the possible starts. They are
    intersected with the offset-adjusted list of the second term, then with those of all other terms in the documents
    that are left.
    """
    postings = index.where("term is not null").select("rid", "pos", "term")
    n = windows.count()
    lists = postings.withColumnRenamed("term", "posted")
    first = by_word(lists, windows.withColumn("term", F.col("term_a")), "posted", n).select(
        "rid", (F.col("pos") - F.col("a")).alias("delta"), "item", "item_id", "j", "len", "b", "term_b"
    )
    second = by_word(lists, windows.select(F.col("term_b").alias("term")).distinct(), "posted", n).select(
        F.col("rid").alias("r2"), F.col("pos").alias("p2"), F.col("posted").alias("t2")
    )
    both = (
        first.where("term_b is not null")
        .join(second, (F.col("rid") == F.col("r2")) & (F.col("delta") + F.col("b") == F.col("p2")) & (F.col("term_b") == F.col("t2")))
        .select("rid", "delta", "item", "item_id", "j", "len")
    )
    candidates = scratch.store(first.where("term_b is null").select(both.columns).unionByName(both), "candidates")
    in_docs = near_rows(postings, candidates)
    wanted = candidates.join(terms.select("item", "ipos", F.col("term").alias("want")), "item").where("ipos >= j and ipos < j + len")
    wanted = wanted.select("rid", (F.col("delta") + F.col("ipos")).alias("pos"), F.col("want").alias("term"), "item", "item_id", "j", "delta", "len")
    found = wanted.join(in_docs, ["rid", "pos", "term"]).groupBy("rid", "item", "item_id", "j", "delta", "len").agg(F.count("*").alias("n"))
    return found.where("n = len").select("rid", "item_id", (F.col("delta") + F.col("j")).alias("start"), "len")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one per row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, each once. Null, empty and wordless texts have no
    words and no hits; the digest of no items is that of the empty string. Without items nothing is hit. Ties between
    equally rare terms go to the earlier one; they don't change the result. Extra columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        terms = scratch.store(item_terms(items.select("item_id", "text")), "item-terms")
        index = scratch.store(build_index(docs.select("doc_id", "text"), terms), "postings")
        counts = index.where("term is not null").groupBy("term").agg(F.count("*").alias("count"))
        windows = scratch.store(plan_windows(terms, counts, width), "windows")
        hits = scratch.store(phrase_matches(scratch, index, terms, windows), "hits")
        by_start = W.partitionBy("rid").orderBy("start")
        spans = hits.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
        covered = F.coalesce(F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
        words = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", covered))).groupBy("rid").agg(F.sum("new").cast("bigint").alias("hit"))
        names = hits.select("rid", F.col("item_id").cast("string").alias("i")).distinct().groupBy("rid").agg(F.sort_array(F.collect_list("i")).alias("ids"))
        rows = index.where("pos = 0").select("rid", "doc_id", "n_words")
        n_hit = F.coalesce("hit", F.lit(0))
        found = (
            rows.join(words, "rid", "left")
            .join(names, "rid", "left")
            .select(
                "doc_id",
                "n_words",
                n_hit.alias("n_hit"),
                F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
                F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
                (n_hit > 0).alias("contaminated"),
            )
        )
        return scratch.result(found, "contamination")


def proximity_matches(index: DataFrame, left: str, right: str, within: int) -> DataFrame:
    """``(rid, pos_left, pos_right)`` where two terms of the index stand at most ``within`` words apart, each way.

    Positions are joined by blocks of ``within`` words and the blocks beside, so that the join is an equi-join.
    """
    block = lambda c: F.floor(F.col(c) / within)
    a = index.where(F.col("term") == left).select("rid", F.col("pos").alias("pos_left")).withColumn("k", F.explode(F.array(*(block("pos_left") + d for d in (-1, 0, 1)))))
    b = index.where(F.col("term") == right).select("rid", F.col("pos").alias("pos_right")).withColumn("k", block("pos_right"))
    near = F.abs(F.col("pos_left") - F.col("pos_right"))
    return a.join(b, ["rid", "k"]).where((near <= within) & (near > 0)).select("rid", "pos_left", "pos_right")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, least_words: int = 1) -> DataFrame:
    """The rows of ``docs`` without ``least_words`` hit words, with all their columns.

    A row goes for its own text: it is named by its text's digest, so rows that share an id are judged apart, rows that
    share a text alike, and rows without an id like others. Null, empty and wordless texts stay; without items all stay;
    an empty table gives an empty result.
    """
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    hit = contamination(docs.select(digest.alias("doc_id"), "text"), items, width).where(F.col("n_hit") >= least_words)
    (key,) = free_names(docs, "gone")
    gone = stored(hit.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return narrow_join(docs, gone, digest == F.col(key), "left_anti", F.xxhash64(F.coalesce(digest, F.lit(b""))), F.xxhash64(key)).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT *, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[j:j + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS j FROM bl)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l)),
h AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

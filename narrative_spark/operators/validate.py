"""Rules over personas and cards; every finding is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T

AT = ["book_id", "character", "chapter_index"]


def ground_quotes(quotes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Quotes with ``grounded``: whether the chapter's text holds them, white space and punctuation aside.

    The quotes of a chapter meet it as one array and are held against its text in place: a text is normalised once,
    however many quotes it has, and doesn't go on.
    """
    own = [c for c in quotes.columns if c not in ("book_id", "chapter_index")]
    asked = quotes.groupBy("book_id", "chapter_index").agg(F.collect_list(F.struct(*own, T.for_matching("text").alias("needle"))).alias("asked"))
    joined = asked.join(chapters.select("book_id", "chapter_index", "content"), ["book_id", "chapter_index"], "left")
    source = joined.select("book_id", "chapter_index", "asked", T.for_matching("content").alias("source"))
    held = F.transform("asked", lambda q: F.struct(*(q[c].alias(c) for c in own), T.grounded(q["needle"], F.col("source")).alias("grounded")))
    return source.select("book_id", "chapter_index", F.inline(held)).select(*quotes.columns, "grounded")


def first_hit(value: Column, phrases: tuple[str, ...] = rules.CLICHES) -> Column:
    """The first of the listed phrases that a value holds, or null."""
    return F.coalesce(*(F.when(F.contains(value, F.lit(p)), F.lit(p)) for p in phrases))


def cliche_findings(found: DataFrame, phrases: tuple[str, ...] = rules.CLICHES, relations: DataFrame | None = None) -> DataFrame:
    """The first stock phrase of each field, and of each relation's change where ``relations(…, target, change)`` are given."""
    told = found.select(*AT, F.col("field").alias("where"), "value")
    if relations is not None:
        told = told.unionByName(relations.select(*AT, F.concat(F.lit("relationships["), F.coalesce("target", F.lit("")), F.lit("]")).alias("where"), F.col("change").alias("value")))
    hit = told.withColumn("hit", first_hit(F.col("value"), phrases)).where("hit is not null")
    return hit.select(*AT, F.lit("cliche").alias("rule"), F.concat("where", F.lit(": 命中套话「"), "hit", F.lit("」")).alias("item"))


def length_findings(found: DataFrame, ranges: dict[str, tuple[int, int]] = rules.FIELD_LENGTHS) -> DataFrame:
    """Fields whose length is out of range; a warning only. The few ranges are constants of the plan."""
    low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
    for f, (a, b) in ranges.items():
        low, high = F.when(F.col("field") == f, a).otherwise(low), F.when(F.col("field") == f, b).otherwise(high)
    size = F.length("value")
    out = found.withColumn("n", size).withColumn("low", low).withColumn("high", high).where("n < low or n > high")
    return out.select(*AT, F.lit("length").alias("rule"), F.format_string(rules.LENGTH_ITEM, "field", "n", "low", "high").alias("item"))


def field_outcomes(found: DataFrame, grounded: DataFrame, strict: bool = False) -> DataFrame:
    """Fields with ``outcome``: ``cleared`` without an offered quote, ``ungrounded`` with none that is grounded
    (``cleared`` too if ``strict``), else ``ok``."""
    offered = grounded.withColumn("field", T.quote_field("field")).groupBy(*AT, "field").agg(F.max(F.col("grounded").cast("int")).alias("any"))
    joined = found.join(offered, [*AT, "field"], "left")
    outcome = F.when(F.col("any").isNull(), "cleared").when(F.col("any") == 0, "cleared" if strict else "ungrounded").otherwise("ok")
    return joined.withColumn("outcome", outcome).drop("any")


def checked(found: DataFrame, quotes: DataFrame, chapters: DataFrame, strict: bool = False, relations: DataFrame | None = None) -> DataFrame:
    """All that the rules say, from texts read and normalised once: ``(…, part, field, value, rule, item, pos)``.

    Rows of part ``field`` are the fields that stay, those of ``quote`` the grounded quotes, those of ``finding`` the
    findings, in the order of the rules: quotes, phrases, lengths, completeness. Keep the table where more than one part
    is read.
    """
    grounded = ground_quotes(quotes, chapters)
    # one array of quotes for each increment meets the array of its fields: nothing is computed twice
    asked = grounded.groupBy(*AT).agg(F.collect_list(F.struct(F.col("field"), F.col("text"), F.col("grounded"), (F.col("pos") if "pos" in quotes.columns else F.lit(0)).alias("pos"))).alias("quotes"))
    known = found.groupBy(*AT).agg(F.collect_list(F.struct(F.col("field_no") if "field_no" in found.columns else F.lit(0).alias("field_no"), "field", "value")).alias("fields"))
    both = known.join(asked, AT, "full")
    if relations is not None:
        both = both.join(relations.groupBy(*AT).agg(F.collect_list(F.struct("target", "change")).alias("relations")), AT, "full")
    else:
        both = both.withColumn("relations", F.lit(None).cast("array<struct<target:string,change:string>>"))
    empty = lambda c: F.coalesce(c, F.array())
    quotes_, fields, told = empty(F.col("quotes")), empty(F.col("fields")), empty(F.col("relations"))
    supports = lambda f, true: F.exists(quotes_, lambda q: (T.quote_field(q["field"]) == f["field"]) & (q["grounded"] if true else F.lit(True)))
    outcome = lambda f: F.when(supports(f, True), "ok").when(F.lit(strict) | ~supports(f, False), "cleared").otherwise("ungrounded")
    judged = F.transform(fields, lambda f: F.struct(f["field_no"].alias("field_no"), f["field"].alias("field"), f["value"].alias("value"), outcome(f).alias("outcome")))
    row = lambda part, field, value, rule, item, pos: F.struct(
        F.lit(part).alias("part"), field.cast("string").alias("field"), value.cast("string").alias("value"), rule.cast("string").alias("rule"), item.cast("string").alias("item"), pos.cast("int").alias("pos")
    )
    null = F.lit(None)
    finding = lambda rule, item: row("finding", null, null, F.lit(rule) if isinstance(rule, str) else rule, item, F.lit(0))
    hits = lambda where, value: finding("cliche", F.concat(where, F.lit(": 命中套话「"), first_hit(value), F.lit("」")))
    target = lambda r: F.concat(F.lit("relationships["), F.coalesce(r["target"], F.lit("")), F.lit("]"))
    low, high = (F.create_map(*(F.lit(x) for f, r in rules.FIELD_LENGTHS.items() for x in (f, r[k]))) for k in (0, 1))
    size = lambda f: F.length(f["value"])
    parts = [
        F.transform(F.filter(judged, lambda f: f["outcome"] != "cleared"), lambda f: row("field", f["field"], f["value"], f["outcome"], null, f["field_no"])),
        F.transform(F.filter(quotes_, lambda q: q["grounded"]), lambda q: row("quote", q["field"], q["text"], null, null, q["pos"])),
        F.transform(F.filter(quotes_, lambda q: ~q["grounded"]), lambda q: finding("quote", F.concat(q["field"], F.lit(": "), F.substring(q["text"], 1, 40)))),
        F.transform(F.filter(fields, lambda f: first_hit(f["value"]).isNotNull()), lambda f: hits(f["field"], f["value"])),
        F.transform(F.filter(told, lambda r: first_hit(r["change"]).isNotNull()), lambda r: hits(target(r), r["change"])),
        F.transform(
            F.filter(fields, lambda f: (size(f) < low[f["field"]]) | (size(f) > high[f["field"]])),
            lambda f: finding("length", F.format_string(rules.LENGTH_ITEM, f["field"], size(f), low[f["field"]], high[f["field"]])),
        ),
        F.transform(F.filter(judged, lambda f: f["outcome"] != "ok"), lambda f: finding(f["outcome"], f["field"])),
    ]
    return both.select(*AT, F.inline(F.concat(*parts)))


def validate(found: DataFrame, quotes: DataFrame, chapters: DataFrame, strict: bool = False, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The fields that stay, with their outcome, and all findings."""
    table = checked(found, quotes, chapters, strict, relations)
    fields = table.where("part = 'field'").select(*AT, F.col("pos").alias("field_no"), "field", "value", F.col("rule").alias("outcome"))
    return fields, table.where("part = 'finding'").select(*AT, "rule", "item")


def merged_findings(findings: DataFrame) -> DataFrame:
    """Each item of a rule once, at its first chapter."""
    key = ["book_id", "character", "rule", "item"]
    return findings.groupBy(*key).agg(F.min("chapter_index").alias("chapter_index"))


def report(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))


# What a card has to have, what it should have, and how long a greeting is.
REQUIRED, EXPECTED = ("name", "description", "personality"), ("desire", "flaw", "secret", "speech_style")
GREETING = (20, 300)


def card_findings(cards: DataFrame, quotes: DataFrame | None = None, first_mes: tuple[int, int] = GREETING) -> DataFrame:
    """``(name, rule, item)`` of every card: missing required fields, empty expected ones, filled ones that no quote
    stands behind, text markers, lengths. Blank fields count as empty.

    Quotes are those of the card's own ``extraction_meta``, or of ``quotes(name, field)``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    blank = lambda c: T.strip(text(c)) == ""
    case = lambda when, rule, item: F.when(when, F.struct(F.lit(rule).alias("rule"), (F.lit(item) if isinstance(item, str) else item).alias("item")))
    if quotes is not None:
        own = quotes.groupBy("name").agg(F.collect_set(T.quote_field("field")).alias("_quoted"))
        cards = cards.join(own, "name", "left")
    elif "extraction_meta" in cards.columns:
        listed = F.from_json(F.get_json_object("extraction_meta", "$.quotes"), "array<struct<field:string>>")
        cards = cards.withColumn("_quoted", F.transform(listed, lambda q: T.quote_field(F.coalesce(q["field"], F.lit("")))))
    else:
        cards = cards.withColumn("_quoted", F.lit(None).cast("array<string>"))
    quoted = F.coalesce("_quoted", F.array().cast("array<string>"))
    example, greeting = text("mes_example"), text("first_mes")
    each = [
        *(case(blank(c), "missing", c) for c in REQUIRED),
        *(case(blank(c), "empty", c) for c in EXPECTED),
        *(case(~blank(c) & ~F.array_contains(quoted, c), "unquoted", c) for c in rules.FIELDS),
        case((example != "") & ~F.contains(example, F.lit("<START>")), "marker", "<START>"),
        case((example != "") & ~F.contains(example, F.lit("{{user}}")) & ~F.contains(example, F.lit("{{char}}")), "placeholder", "{{user}} / {{char}}"),
        case((greeting != "") & ~F.length(greeting).between(*first_mes), "length", F.concat(F.lit("first_mes: "), F.length(greeting).cast("string"))),
    ]
    return cards.select("name", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("rule", "item"))


def card_ok(findings: DataFrame, cards: DataFrame) -> DataFrame:
    """``(name, ok)``: whether a card lacks nothing that it has to have."""
    bad = findings.where("rule = 'missing'").select("name").distinct().withColumn("bad", F.lit(True))
    return cards.select("name").join(bad, "name", "left").select("name", F.col("bad").isNull().alias("ok"))


def unquoted_fields(cards: DataFrame, quotes: DataFrame) -> DataFrame:
    """Filled card fields that no quote stands behind."""
    return card_findings(cards, quotes).where("rule = 'unquoted'").select("name", F.col("item").alias("field"))

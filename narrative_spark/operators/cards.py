"""Role cards: assembly, export and the import of three shapes.

A card is a row. Its lists are arrays of structs; what a card format carries without a meaning here (``extraction_meta``,
unknown keys of lore entries) is kept as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.model import once, parsed

# Names of the card format.
STANDARD = ("name", "description", "personality", "scenario", "first_mes", "mes_example", "creator_notes")
STRUCTURED = ("desire", "flaw", "secret", "speech_style")
SPECS = ("chara_card_v2", "chara_card_v3")
LORE = {"keys": "array<string>", "content": "string", "enabled": "boolean", "insertion_order": "int", "case_sensitive": "boolean"}
TIMELINE = {"id": "string", "order": "int", "summary": "string", "actors": "array<string>", "chapter": "string", "quote": "string"}
RELATIONS = {"from": "string", "to": "string", "kind": "string", "description": "string", "evolution": "array<string>"}
PLOT_NODES = {"id": "string", "order": "int", "title": "string", "description": "string", "chapter": "string", "branch": "string"}
LISTS = {"timeline": TIMELINE, "relations": RELATIONS, "plot_nodes": PLOT_NODES}
#: Fields that may be missing, and the defaults that aren't empty.
NULLABLE, DEFAULTS = {"chapter", "quote"}, {"branch": "canon"}
#: Fields whose length a build reports.
MEASURED = ("name", "description", "personality", "desire", "flaw", "secret", "speech_style", "first_mes", "mes_example")
DEFAULT_TAG, GENERATOR = "novel", "narrative_spark"


def struct_type(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def description(source: Column | None = None) -> Column:
    """One labelled line for each field that is filled, and the source."""
    lines = [F.when(F.coalesce(F.col(f), F.lit("")) != "", F.concat(F.lit(label + "："), F.col(f))) for f, label in rules.FIELD_LABELS.items()]
    if source is not None:
        lines.append(F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("来源：《"), source, F.lit("》"))))
    return F.concat_ws("\n", *lines)


def relation_list(rows: DataFrame) -> DataFrame:
    """``(book_id, character, relations)`` of :func:`persona.relation_rows`, in the order of a target's first change."""
    one = F.struct(F.col("character").cast("string").alias("from"), F.col("target").alias("to"), F.lit("").alias("kind"), F.col("description"), F.col("evolution"))
    order = F.array_sort(F.collect_list(F.struct("first_seq", one.alias("r"))))
    return rows.groupBy("book_id", "character").agg(F.transform(order, lambda x: x["r"]).alias("relations"))


def timeline_list(events: DataFrame) -> DataFrame:
    """``(book_id, character, timeline)`` of :func:`persona.timeline_events`."""
    one = F.struct("id", F.col("event_order").alias("order"), "summary", _none("array<string>").alias("actors"), "chapter", F.nullif(F.col("quote"), F.lit("")).alias("quote"))
    order = F.array_sort(F.collect_list(F.struct(F.col("event_order").alias("o"), F.to_json(one).alias("tie"), one.alias("e"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return events.groupBy("book_id", "character").agg(F.transform(order, lambda x: x["e"]).alias("timeline"))


def meta_list(quotes: DataFrame, conflicts: DataFrame, samples: DataFrame) -> DataFrame:
    """``(book_id, character, extraction_meta)``: quotes, samples and changes of a character as JSON."""
    keys = ["book_id", "character"]
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    said = quotes.groupBy(*keys).agg(F.transform(in_order("chapter_index", "pos", "field", "text", "confidence"), lambda x: F.struct(x["field"].alias("field"), x["text"].alias("text"), x["confidence"].alias("confidence"))).alias("quotes"))
    told = conflicts.groupBy(*keys).agg(
        F.transform(
            in_order("chapter_index", "src", "pos", "field", "from", "to", "reason"),
            lambda x: F.struct(x["field"].alias("field"), x["from"].alias("from"), x["to"].alias("to"), x["reason"].alias("reason")),
        ).alias("changes")
    )
    joined = said.join(told, keys, "full").join(samples, keys, "full")
    whole = F.struct(
        F.coalesce("quotes", _none("array<struct<field:string,text:string,confidence:string>>")).alias("quotes"), F.coalesce("speech_samples", _none("array<string>")).alias("speech_samples"),
        F.coalesce("changes", _none("array<struct<field:string,`from`:string,`to`:string,reason:string>>")).alias("changes"), F.col("book_id"), F.lit(GENERATOR).alias("generator"),
    )
    return joined.select(*keys, F.to_json(whole, {"ignoreNullFields": "false"}).alias("extraction_meta"))


def build(personas: DataFrame, default_tag: str = DEFAULT_TAG) -> DataFrame:
    """Cards of ``(book_id, character, fields…)``, with the lists and texts that the rows have. What wasn't observed
    stays empty; tags begin with the default."""
    tags = F.col("tags") if "tags" in personas.columns else _none("array<string>")
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in personas.columns else F.lit("")
    listed = lambda c, kind: F.coalesce(F.col(c), _none(kind)) if c in personas.columns else _none(kind)
    source = F.col("source_book") if "source_book" in personas.columns else F.col("book_id")
    meta = F.col("extraction_meta") if "extraction_meta" in personas.columns else F.to_json(F.struct("book_id", F.lit(GENERATOR).alias("generator")))
    return personas.select(
        "book_id",
        F.col("character").cast("string").alias("name"),
        description(source).alias("description"),
        *(have(c).alias(c) for c in ("personality", "scenario", "first_mes", "mes_example", "creator_notes")),
        F.array_distinct(F.concat(F.array(F.lit(default_tag)), tags)).alias("tags"),
        F.lit("1.0").alias("character_version"),
        *(have(c).alias(c) for c in STRUCTURED),
        *(listed(c, f"array<{struct_type(fields)}>").alias(c) for c, fields in LISTS.items()),
        listed("character_book", f"array<{struct_type(LORE)}>").alias("character_book"),
        F.lit(None).cast("array<string>").alias("lore"),
        F.nullif(source, F.lit("")).alias("source_book"),
        meta.alias("extraction_meta"),
    )


def counters(cards: DataFrame) -> DataFrame:
    """What a build reports: lengths of fields, and how many relations, changes of relations, events, quotes, samples."""
    meta = lambda key: F.coalesce(F.expr(f"size(try_variant_get(try_parse_json(extraction_meta), '$.{key}', 'array<variant>'))"), F.lit(0))
    total = F.aggregate("relations", F.lit(0), lambda n, r: n + F.size(r["evolution"]))
    count = lambda c: F.greatest(F.lit(0), c)
    return cards.select(
        "name", *(F.length(c).alias(f"{c}_length") for c in MEASURED[1:]), F.size("tags").alias("n_tags"), F.size("relations").alias("relation_count"),
        total.alias("relation_evolution_total"), F.size("timeline").alias("timeline_count"), count(meta("quotes")).alias("quote_count"), count(meta("speech_samples")).alias("speech_sample_count"),
    )


def _json(c: Column) -> Column:
    """A value as a variant that keeps its nulls."""
    return F.parse_json(F.to_json(c, {"ignoreNullFields": "false"}))


def to_json(cards: DataFrame, namespace: str = "narrative") -> DataFrame:
    """``(name, json)``: standard fields under ``data``, the others under an extension of this namespace.

    Unknown keys that lore entries came with go back into them, entry by entry, and into the extension's ``lore``.
    """
    own = lambda c, kind: F.coalesce(F.col(c), _none(kind)) if c in cards.columns else _none(kind)
    book, lore = own("character_book", f"array<{struct_type(LORE)}>"), own("lore", "array<string>")

    def entry(x: Column) -> Column:
        known, extra = F.to_json(x["e"], {"ignoreNullFields": "false"}), F.coalesce(x["o"], F.lit("{}"))
        both = F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra)))
        return F.parse_json(F.when(extra == "{}", known).otherwise(both))

    entries = F.transform(F.arrays_zip(book.alias("e"), F.when(F.size(lore) > 0, lore).otherwise(F.transform(book, lambda _: F.lit(None).cast("string"))).alias("o")), entry)
    has = lambda c: c in cards.columns
    meta = F.try_parse_json(F.when(~F.col("extraction_meta").isin("", "{}"), F.col("extraction_meta"))) if has("extraction_meta") else F.lit(None).cast("variant")
    extension = F.struct(
        *(F.col(c).alias(c) for c in STRUCTURED),
        *(_json(own(c, f"array<{struct_type(fields)}>")).alias(c) for c, fields in LISTS.items()),
        *([F.col("source_book")] if has("source_book") else []),
        meta.alias("extraction_meta"),
        F.when(F.size(lore) > 0, F.transform(lore, F.parse_json)).alias("lore"),
    )
    data = F.struct(*(F.col(c) for c in STANDARD), "tags", "character_version", F.struct(entries.alias("entries")).alias("character_book"), F.struct(extension.alias(namespace)).alias("extensions"))
    return cards.select("name", F.to_json(F.struct(F.lit(SPECS[0]).alias("spec"), F.lit("2.0").alias("spec_version"), data.alias("data"))).alias("json"))


def _kind(v: Column) -> Column:
    """The schema of a variant, which is slow: it walks through the whole value."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _void(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def as_text(v: Column) -> Column:
    """A variant as text: a missing one is empty, truth values are spelt ``True`` and ``False``."""
    truth = lambda v, s: F.when(s.isin("true", "false") & (_kind(v) == "BOOLEAN"), F.initcap(s)).otherwise(s)
    return once(v, lambda v: F.coalesce(once(F.try_variant_get(v, "$", "string"), lambda s: truth(v, s)), F.when(~_void(v), F.to_json(v)), F.lit("")))


def as_list(v: Column) -> Column:
    """A variant as a list of texts: a filled text or a number is a list of one."""
    many = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), as_text)
    alone = lambda v: once(as_text(v), lambda one: F.when(one == "", _none("array<string>")).otherwise(F.array(one)))
    return once(v, lambda v: F.coalesce(many(v), alone(v)))


def as_bool(v: Column, default: bool) -> Column:
    """A variant as a truth value: texts by meaning, numbers unless zero, anything else by default."""

    def of(v: Column, kind: Column) -> Column:
        number = F.try_variant_get(v, "$", "double")
        said = F.lower(F.trim(F.try_variant_get(v, "$", "string"))).isin("1", "true", "yes", "on")
        return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", said).when(number.isNotNull(), number != 0).otherwise(F.lit(default))

    return once(v, lambda v: once(_kind(v), lambda kind: of(v, kind)))


def as_int(v: Column, default: int = 0) -> Column:
    """A variant as a whole number: fractions are cut off, texts have to be whole numbers."""

    def of(v: Column, kind: Column) -> Column:
        said = F.trim(F.try_variant_get(v, "$", "string"))
        text = F.when(said.rlike(r"^[+-]?\d{1,9}$"), said.try_cast("int"))
        number = F.try_variant_get(v, "$", "double").try_cast("int")
        return F.coalesce(F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).otherwise(number), F.lit(default))

    return once(v, lambda v: once(_kind(v), lambda kind: of(v, kind)))


def _filled(*options: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*(F.nullif(as_text(v), F.lit("")) for v in options), F.lit(""))


def _objects(v: Column, fields: dict[str, str]) -> Column:
    """Structs of a list's objects, other elements left out; what an object lacks has its default."""
    read = {"string": as_text, "int": as_int, "array<string>": as_list}

    def one(x: Column) -> Column:
        made = []
        for k, kind in fields.items():
            value = read[kind](_get(x, k))
            if k in NULLABLE:
                value = F.when(~_void(_get(x, k)), value)
            elif k in DEFAULTS:
                value = F.when(_void(_get(x, k)), DEFAULTS[k]).otherwise(value)
            made.append(value.alias(k))
        return F.struct(*made)

    return F.coalesce(F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), _is_object), one), _none(f"array<{struct_type(fields)}>"))


def import_cards(raw: DataFrame, namespace: str = "narrative") -> DataFrame:
    """Cards of ``(id, json)`` in any of three shapes: wrapped, with a spec but flat, or bare.

    Extensions beat flat fields; missing ones get their defaults; alternate names are known; lore comes as a list or
    under ``entries``, its unknown keys are kept. What isn't an object has ``ok`` false and empty fields.
    """
    v = raw.withColumn("v", parsed("json"))
    v = v.withColumn("ok", _is_object(F.col("v"))).withColumn("v", F.when(F.col("ok"), F.col("v")))
    inner = _get(F.col("v"), "data")
    wrapped = _is_object(inner) & (F.coalesce(_get(F.col("v"), "spec", "string"), F.lit("")).isin(*SPECS) | _get(F.col("v"), "name").isNull())
    v = v.withColumn("d", F.when(wrapped, inner).otherwise(F.col("v"))).withColumn("e", F.try_variant_get("d", f"$.extensions['{namespace}']", "variant"))
    flat = lambda k: _get(F.col("d"), k)
    deep = lambda k: F.coalesce(_get(F.col("e"), k), flat(k))  # noqa: E731 - a key of the extension counts even if it is null
    book = flat("character_book")
    items = F.filter(F.coalesce(F.try_variant_get(book, "$.entries", "array<variant>"), F.try_variant_get(book, "$", "array<variant>"), _none("array<variant>")), _is_object)
    v = v.withColumn("items", items)

    def entry(x: Column) -> Column:
        keys = F.when(F.size(as_list(_get(x, "keys"))) > 0, as_list(_get(x, "keys"))).otherwise(as_list(_get(x, "key")))
        return F.struct(
            keys.alias("keys"), as_text(_get(x, "content")).alias("content"), as_bool(_get(x, "enabled"), True).alias("enabled"),
            as_int(_get(x, "insertion_order")).alias("insertion_order"), as_bool(_get(x, "case_sensitive"), False).alias("case_sensitive"),
        )

    extra = F.transform("items", lambda x: F.to_json(F.map_filter(F.try_variant_get(x, "$", "map<string,variant>"), lambda k, _: ~k.isin("key", *LORE))))
    meta = _get(F.col("e"), "extraction_meta")
    return v.select(
        "id", "ok", *(as_text(flat(c)).alias(c) for c in ("name", "description", "personality", "scenario")), _filled(flat("first_mes"), flat("first_message")).alias("first_mes"),
        _filled(flat("mes_example"), flat("example_dialogue")).alias("mes_example"), as_text(flat("creator_notes")).alias("creator_notes"), as_list(flat("tags")).alias("tags"),
        F.coalesce(F.nullif(as_text(flat("character_version")), F.lit("")), F.lit("1.0")).alias("character_version"),
        *(as_text(deep(c)).alias(c) for c in STRUCTURED), *(_objects(deep(c), fields).alias(c) for c, fields in LISTS.items()),
        F.transform("items", entry).alias("character_book"), F.when(F.exists(extra, lambda x: x != "{}"), extra).alias("lore"),
        F.nullif(as_text(deep("source_book")), F.lit("")).alias("source_book"), F.when(_is_object(meta), F.to_json(meta)).alias("extraction_meta"),
    )

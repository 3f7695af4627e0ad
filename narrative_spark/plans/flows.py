"""The three flows end to end: raw files to chapters, chapters to names, chapters to personas and cards."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..config import Settings
from ..functions import model
from ..functions import text as T
from ..operators import aliases, cards, names, persona, segment, validate
from ..runtime import kept, ship_package
from ..sources import files
from ..sources.files import canonical_chunks  # noqa: F401 - part of the flow's interface

Completion = Callable[[str], dict]

#: Templates with the variables that a flow fills; callers give their own.
TEMPLATES = {
    "names": "List the names of the people in this text as JSON {\"characters\": [...]}.\n\n{title}\n\n{text}",
    "aliases": "Group the names of one person as JSON {\"groups\": [{\"main\", \"aliases\", \"reason\"}]}.\n\n{names}\n\n{evidence}",
    "persona": "Known so far:\n{existing_persona}\n\nDescribe {character} from these passages as JSON.\n\n{text}",
    "card": "Write the greeting and an example dialogue of {character} as JSON.\n\n{description}\n\n{samples}",
}


def ingest(spark: SparkSession, path: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``(books, chapters)`` of the text files under a path."""
    books = files.read_books(spark, path)
    found = segment.segment(books.select("book_id", "text"), settings.fallback_length)
    chapters = segment.split_long(found, settings.chapter_length)
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("chapter_count"))
    return books.drop("text").join(counts, "book_id", "left").fillna(0, ["chapter_count"]), chapters


def scan_chapters(chapters: DataFrame, complete: Completion, template: str = TEMPLATES["names"], retries: int = 2) -> DataFrame:
    """``(book_id, chapter_index, fingerprint, chunks, calls, failed)``: one call a piece of a chapter.

    A reply that can't be read is an empty list and one more failed call.
    """
    keyed = names.with_fingerprint(chapters)
    pieces = keyed.select(*names.KEY, F.coalesce(F.nullif("title", F.lit("")), F.lit("（无标题）")).alias("title"), F.posexplode("pieces").alias("chunk_no", "piece"))
    called = model.complete_rows(pieces.select(*names.KEY, "chunk_no", T.render(F.lit(template), {"title": F.col("title"), "text": F.col("piece")}).alias("prompt")), complete, retries)
    bad = F.col("ok") & model.parsed(model.unfenced("content")).isNull()
    rows = called.withColumn("names", model.names_of("content")).withColumn("bad", ~F.col("ok") | bad)
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "names"))), lambda x: x["names"])
    return rows.groupBy(*names.KEY).agg(chunks.alias("chunks"), F.count("*").alias("calls"), F.count_if("bad").alias("failed"))


def cached_scan(chapters: DataFrame, cache: DataFrame | None, complete: Completion, force: bool = False, **how) -> DataFrame:
    """The scan of all chapters; those that the cache has under their fingerprint aren't sent to the model."""
    if cache is None or force:
        return scan_chapters(chapters, complete, **how)
    keyed = names.with_fingerprint(chapters)
    missing = names.cache_misses(keyed, cache).select("book_id", "chapter_index", "title", "content")
    return names.cache_hits(keyed, cache).select(*names.KEY, "chunks").unionByName(scan_chapters(missing, complete, **how).select(*names.KEY, "chunks"))


def identify(chapters: DataFrame, scanned: DataFrame, top: int = 15) -> DataFrame:
    """Ranked candidates under the source's spelling, with their first three contexts."""
    found = names.mentions(scanned)
    spelled = names.normalised(found, names.source_forms(found.select("book_id", "name"), chapters))
    ranked = names.rank(spelled, top)
    said = names.contexts(ranked, chapters).groupBy("book_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"]).alias("contexts"))
    return ranked.join(said, ["book_id", "name"], "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def evidence_block(found: DataFrame) -> DataFrame:
    """One text for each book: its pairs by tier, each tier under its heading, with their proofs in the order of the text."""
    forced = F.col("tier") == "forced"
    line = F.concat(F.lit("- "), "a", F.when(forced, " = ").otherwise(" ?= "), "b", F.lit("    原文："), "proof")
    rows = found.select("book_id", F.when(forced, 0).otherwise(2).alias("o"), "seq", line.alias("line"))
    heads = found.select("book_id", F.when(forced, 0).otherwise(2).alias("o")).distinct()
    heads = heads.select("book_id", "o", F.lit(-1).cast("bigint").alias("seq"), F.when(F.col("o") == 0, rules.EVIDENCE_FORCED).otherwise(rules.EVIDENCE_HINTS).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("o", F.col("seq").cast("bigint").alias("seq"), "line")))
    return rows.withColumn("seq", F.col("seq").cast("bigint")).unionByName(heads).groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("evidence"))


def merge_aliases(candidates: DataFrame, chapters: DataFrame, complete: Completion, template: str = TEMPLATES["aliases"], retries: int = 2) -> DataFrame:
    """``(book_id, main, alias)``: the model's groups, then forced evidence and name containment, then the guard.

    Candidates without a context don't go to the model, nor does a book with fewer than two. Forbidden pairs win over
    all others. Evidence and replies are tables of their own, so a book's reply is asked for once.
    """
    ordered = candidates.select("book_id", (F.col("rank") - 1).alias("pos"), "name")
    texts = chapters.select("book_id", "chapter_index", F.col("content").alias("text"))
    forbidden = kept(aliases.forbidden_pairs(aliases.family_relations(texts), ordered, rules.MOST_PAIRS), "forbidden-pairs")
    proofs = kept(aliases.evidence(aliases.marker_matches(texts, ordered), forbidden), "evidence")
    sent, _ = aliases.with_contexts(candidates)
    line = F.struct("rank", F.concat(F.lit("- "), "name", F.lit("："), names.context_lines(F.col("contexts"))).alias("line"))
    listed = sent.groupBy("book_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("names")).where("n > 1")
    asked = listed.join(evidence_block(proofs), "book_id", "left").select("book_id", T.render(F.lit(template), {"names": F.col("names"), "evidence": F.coalesce("evidence", F.lit("（无）"))}).alias("prompt"))
    replies = kept(model.complete_rows(asked, complete, retries), "alias-replies")
    told = replies.select("book_id", F.posexplode(model.alias_groups_of("content")).alias("pos", "g")).select("book_id", "pos", "g.main", F.explode("g.aliases").alias("alias"))
    asked_of = replies.select("book_id").distinct()
    merged = aliases.merge_groups(told, proofs.where("tier = 'forced'").join(asked_of, "book_id", "left_semi"), ordered.join(asked_of, "book_id", "left_semi"))
    return aliases.guard(merged, forbidden)


FINDING = "array<struct<rule:string,item:string>>"
INCREMENT = (
    "book_id string, character string, chapter_index int, personality string, desire string, flaw string, secret string, speech_style string, relationships array<struct<target:string,change:string>>, "
    "quotes array<struct<field:string,text:string,confidence:string>>, speech_samples array<string>, changes array<struct<field:string,`from`:string,`to`:string,reason:string>>, "
    f"findings {FINDING}, calls int, failed int"
)
LISTS = {"relationships": ("target", "change"), "quotes": ("field", "text", "confidence"), "changes": ("field", "from", "to")}
#: What makes two rows of a list the same.
SAME = {"relationships": ("target", "change"), "quotes": ("field", "text"), "changes": ("field", "from", "to")}


def _reply(content: str) -> dict:
    """The increment of a reply; a lone string or object where a list belongs is a list of one."""
    data = json.loads(re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", content.strip()))
    if not isinstance(data, dict):
        raise ValueError("the reply isn't an object")
    out: dict = {f: str(data.get(f) or "").strip() for f in rules.FIELDS}
    for key, parts in LISTS.items():
        rows = data.get(key) or []
        rows = [rows] if isinstance(rows, dict) else rows
        parts = (*parts, "reason") if key == "changes" else parts
        out[key] = [{p: str(x.get(p) or "") for p in parts} for x in rows if isinstance(x, dict)]
    samples = data.get("speech_samples") or []
    out["speech_samples"] = [str(x) for x in ([samples] if isinstance(samples, str) else samples)]
    return out


_IGNORED = re.compile(rules.IGNORED_IN_QUOTES)


def _judged(one: dict, source: str) -> list[tuple[str, str]]:
    """Hold an increment against its chapter's normalised text, as :func:`validate.checked` does for tables: quotes that
    the text lacks go, and fields that no quote was offered for. Returns the findings."""
    true = [q for q in one["quotes"] if (needle := _IGNORED.sub("", q["text"])) and needle in source]
    base = lambda q: q["field"].split("@ch", 1)[0]
    found = [("quote", f"{q['field']}: {q['text'][:40]}") for q in one["quotes"] if q not in true]
    texts = {f: one[f] for f in rules.FIELDS} | {f"relationships[{r['target']}]": r["change"] for r in one["relationships"]}
    found += [("cliche", f"{where}: 命中套话「{hit}」") for where, value in texts.items() if (hit := next((p for p in rules.CLICHES if p in value), None))]
    for f, (low, high) in rules.FIELD_LENGTHS.items():
        if one[f] and not low <= len(one[f]) <= high:
            found.append(("length", rules.LENGTH_ITEM % (f, len(one[f]), low, high)))
    offered, shown = set(map(base, one["quotes"])), set(map(base, true))
    for f in rules.FIELDS:
        if one[f] and f not in shown:
            found.append(("ungrounded" if f in offered else "cleared", f))
            one[f] = one[f] if f in offered else ""
    one["quotes"] = true
    return found


def _merge(parts: list[dict]) -> dict:
    """One chapter's batches: the first value of a field, and each list's distinct rows in order."""
    out: dict = {f: next((p[f] for p in parts if p[f]), "") for f in rules.FIELDS}
    for key, by in SAME.items():
        out[key] = list({tuple(x[k] for k in by): x for p in reversed(parts) for x in reversed(p[key])}.values())[::-1]
    out["speech_samples"] = list(dict.fromkeys(s for p in parts for s in p["speech_samples"]))
    return out


class _Known:
    """What earlier chapters say of a character, and the text of it that goes into the next prompt.

    The text is that of :func:`persona.summary`, which makes it of tables.
    """

    def __init__(self, limit: int = 12, chars: int = 40, changes: int = 5):
        self.fields: dict[str, str] = {}
        self.relations: list[tuple[str, str]] = []
        self.changes: list[tuple[str, str, str]] = []
        self.limit, self.chars, self.most_changes = limit, chars, changes

    def add(self, one: dict) -> None:
        for f in rules.FIELDS:
            if one[f]:
                if self.fields.get(f, one[f]) != one[f]:
                    self.changes.append((f, self.fields[f], one[f]))
                self.fields[f] = one[f]
        self.relations += [(r["target"], r["change"].strip()) for r in one["relationships"] if r["target"] or r["change"]]
        self.changes += [(c["field"], c["from"], c["to"]) for c in one["changes"]]

    def text(self) -> str:
        older = len(self.relations) - self.limit
        cut = lambda x: x if len(x) <= self.chars else x[: self.chars] + "…"
        lines = [
            *(rules.SUMMARY_FIELD % (label, self.fields[f]) for f, label in rules.FIELD_LABELS.items() if f in self.fields),
            *(rules.SUMMARY_RELATION % (target, cut(change)) for target, change in self.relations[max(0, older) :]),
            *([rules.SUMMARY_OMITTED % older] if older > 0 else []),
            *(rules.SUMMARY_CHANGE % c for c in self.changes[: self.most_changes] if c[0]),
        ]
        return "\n".join(lines) or rules.SUMMARY_EMPTY


def extract(
    chapters: DataFrame, characters: DataFrame, complete: Completion, template: str = TEMPLATES["persona"], most: int = 5000, retries: int = 2, keep_title: bool = False
) -> DataFrame:
    """Increments of ``characters(book_id, character, names)``, one a chapter, those of chapters without a passage empty.

    Passages are found and packed by Spark. Each reply is held against the whole chapter, and what stands is known to the
    prompt of the next chapter, so a character's chapters follow each other in one task; characters and books run side by
    side. A task gets a chapter's packed passages and its normalised text only where a passage names the character.
    """
    ship_package(chapters.sparkSession)
    named = lambda b: F.exists("names", lambda n: (n != "") & F.contains(b, n))
    blocks = F.filter(segment.blocks("content", "title", keep_title), named)
    held = chapters.join(characters, "book_id").select(
        "book_id", "character", F.col("chapter_index").cast("int").alias("chapter_index"), F.coalesce("title", F.lit("")).alias("title"),
        F.array_join("names", "、").alias("called"), segment.batches(blocks, most).alias("batches"), F.when(F.size(blocks) > 0, T.for_matching("content")).alias("source"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known, rows = _Known(), []
        for book, who, chapter, title, called, batches, source in group.sort_values("chapter_index").itertuples(index=False):
            parts, findings, calls, failed = [], [], 0, 0
            values = {"character": who, "aliases": called, "chapter_index": str(chapter), "chapter_title": title, "existing_persona": known.text()}
            for text in batches:
                prompt = re.sub(r"\{(\w+)\}", lambda m: {**values, "text": text}.get(m[1], m[0]), template)
                for _ in range(2):  # a reply that can't be read is asked for once more
                    got = model.call_with_retry(complete, prompt, retries)
                    calls += got["attempts"]
                    if not got["ok"]:
                        raise RuntimeError(f"chapter {chapter}: {got['error']}")
                    try:
                        parts.append(_reply(got["content"]))
                        break
                    except ValueError:
                        failed += 1
                else:
                    raise RuntimeError(f"chapter {chapter}: no readable reply")
                findings += _judged(parts[-1], source)
            one = _merge(parts)
            known.add(one)
            told = [{"rule": r, "item": i} for r, i in dict.fromkeys(findings)]
            rows.append({"book_id": book, "character": who, "chapter_index": chapter, **one, "findings": told, "calls": calls, "failed": failed})
        return pd.DataFrame(rows)

    return held.groupBy("book_id", "character").applyInPandas(run, INCREMENT)


def fold(increments: DataFrame, chapters: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """Facts that stand, their change log, the current persona, relations, grounded quotes, samples and all findings.

    Increments of :func:`extract` bring their findings; others are held against their ``chapters`` first.
    """
    at = ["book_id", "character", "chapter_index"]
    found = persona.facts(increments)
    quotes = increments.select(*at, F.posexplode("quotes").alias("pos", "q")).select(*at, "pos", "q.field", "q.text", F.coalesce("q.confidence", F.lit("")).alias("confidence"))
    told = increments.select(*at, F.posexplode("relationships").alias("pos", "r")).select(*at, "pos", "r.target", "r.change")
    if "findings" in increments.columns:
        findings = increments.select(*at, F.inline("findings"))
    else:
        table = kept(validate.checked(found, quotes, chapters, strict, told), "checked-increments")
        found = table.where("part = 'field'").select(*at, F.col("pos").alias("field_no"), "field", "value")
        quotes = quotes.join(table.where("part = 'quote'").select(*at, "pos"), [*at, "pos"], "left_semi")
        findings = table.where("part = 'finding'").select(*at, "rule", "item")
    seq = F.row_number().over(W.partitionBy("book_id", "character").orderBy("chapter_index", "pos"))
    log = persona.change_log(found)
    return {
        "facts": found,
        "log": log,
        "persona": persona.current(found),
        "conflicts": persona.conflicts(log, increments),
        "relations": persona.relation_rows(told.select("book_id", "character", seq.alias("seq"), "target", "change")),
        "timeline": persona.timeline_events(log),
        "quotes": persona.tagged_quotes(quotes),
        "samples": persona.samples(increments),
        "findings": validate.merged_findings(findings),
    }


def card_texts(made: DataFrame, samples: DataFrame, complete: Completion, template: str = TEMPLATES["card"], most: int = 12, retries: int = 2) -> DataFrame:
    """Cards with a greeting and an example dialogue of the model, from a description and up to ``most`` samples.

    A reply that isn't an object is asked for once more; then it is an error, never a card with empty texts.
    """
    some = samples.select("book_id", F.col("character").cast("string").alias("name"), persona.speech_head(F.col("speech_samples"), most).alias("_samples"))
    asked = made.join(some, ["book_id", "name"], "left")
    prompt = T.render(F.lit(template), {"character": F.col("name"), "description": F.col("description"), "samples": F.coalesce(F.array_join(F.transform("_samples", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")) })
    called = kept(model.complete_rows(asked.select("book_id", "name", prompt.alias("prompt")), complete, retries, readable=model.is_object), "card-replies")
    v = model.parsed(model.unfenced("content"))
    whole = F.when(F.col("ok"), v).otherwise(F.raise_error(F.concat("name", F.lit(": "), "error")))
    texts = called.select("book_id", "name", whole.alias("v"))
    text = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit(""))
    return made.drop("first_mes", "mes_example").join(texts, ["book_id", "name"]).withColumns({"first_mes": text("first_mes"), "mes_example": text("mes_example")}).select(made.columns)


def build(folded: dict[str, DataFrame], default_tag: str = cards.DEFAULT_TAG, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(cards, findings)`` of folded personas with their relations, timeline, quotes, samples and changes.

    ``texts(book_id, character, first_mes, mes_example)`` come from the model, where it has been asked.
    """
    keys = ["book_id", "character"]
    meta = cards.meta_list(folded["quotes"], folded["conflicts"], folded["samples"])
    rows = folded["persona"].join(cards.relation_list(folded["relations"]), keys, "left").join(cards.timeline_list(folded["timeline"]), keys, "left").join(meta, keys, "left")
    if texts is not None:
        rows = rows.join(texts.select(*keys, "first_mes", "mes_example"), keys, "left")
    made = cards.build(rows, default_tag)
    return made, validate.card_findings(made)

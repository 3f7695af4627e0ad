"""An external completion model as an injected function, with retries, counters and tolerant parsing of its JSON."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .text import clean_name, col

Completion = Callable[[str], dict]
CALL = "content string, ok boolean, attempts int, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint, error string"


def call_with_retry(complete: Completion, prompt: str, retries: int = 2, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One call; failures are tried again after 1, 2, … times ``backoff`` seconds. The last failure is returned as a row."""
    error = ""
    for attempt in range(1, retries + 2):
        try:
            got = complete(prompt)
            return {"content": got.get("content", ""), "ok": True, "attempts": attempt, "error": None} | {
                k: int(got.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "cached_tokens")
            }
        except Exception as e:  # any failure of an external service is a failed call
            error = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                sleep(backoff * attempt)
    return {"content": None, "ok": False, "attempts": retries + 1, "prompt_tokens": 0, "completion_tokens": 0, "cached_tokens": 0, "error": error}


def is_object(content: str) -> bool:
    """Whether a reply is a JSON object, fenced or not."""
    try:
        return isinstance(json.loads(re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", content.strip())), dict)
    except ValueError:
        return False


def read_with_retry(complete: Completion, prompt: str, readable: Callable[[str], bool], tries: int = 2, **how) -> dict:
    """A call whose reply has to be readable: it is asked for ``tries`` times, then the call counts as failed. Attempts
    and tokens of all tries are added up."""
    total: dict = {}
    for _ in range(tries):
        got = call_with_retry(complete, prompt, **how)
        total = got | {k: got[k] + total.get(k, 0) for k in ("attempts", "prompt_tokens", "completion_tokens", "cached_tokens")}
        if not got["ok"] or readable(got["content"]):
            return total
    return total | {"ok": False, "error": f"no readable reply in {tries} tries"}


def complete_rows(prompts: DataFrame, complete: Completion, retries: int = 2, backoff: float = 1.0, readable: Callable[[str], bool] | None = None) -> DataFrame:
    """``prompts`` (with a column ``prompt``) plus the columns of a call, one call a row, in Arrow batches.

    ``complete`` is sent to the workers, so it must be serialisable; a service's client belongs inside it. With
    ``readable``, replies that aren't are asked for once more. A plan that is read twice calls twice: keep its table.
    """
    ship_package(prompts.sparkSession)
    names = [x.split()[0] for x in CALL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ask = lambda p: read_with_retry(complete, p, readable, retries=retries, backoff=backoff) if readable else call_with_retry(complete, p, retries, backoff)
            calls = pd.DataFrame([ask(p) for p in batch["prompt"]], columns=names, index=batch.index)
            yield pd.concat([batch, calls], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{kinds}, {CALL}")


def unfenced(c: Column | str) -> Column:
    """A reply without the fence that models put around JSON."""
    return F.trim(F.regexp_replace(F.trim(col(c)), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def parsed(c: Column | str) -> Column:
    """JSON as a variant, null unless the text is one value and nothing else.

    The parser stops behind a first value; in brackets and in braces, what follows a value shows, a closing one too.
    """
    whole = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    return once(col(c), lambda c: F.when(whole(c), F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit("}"))), "$.x", "variant")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, for which ``value`` is computed once a row, however often and under whatever conditions it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _list(json_text: Column, *paths: str) -> Column:
    return once(parsed(json_text), lambda v: F.coalesce(*(F.try_variant_get(v, p, "array<string>") for p in paths)))


def names_of(reply: Column | str, keys: tuple[str, ...] = ("characters", "names", "people", "result")) -> Column:
    """The distinct names of a reply, in order: a bare array or one under any of the keys. Bad JSON gives none."""
    found = _list(unfenced(reply), *(f"$.{k}" for k in keys), "$")
    cleaned = F.filter(F.transform(found, clean_name), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


GROUP = "array<struct<main:string,aliases:array<string>,reason:string>>"


def alias_groups_of(reply: Column | str) -> Column:
    """Groups with a main name; the main name isn't one of its aliases, and groups without aliases go."""
    groups = once(parsed(unfenced(reply)), lambda v: F.coalesce(F.try_variant_get(v, "$.groups", GROUP), F.try_variant_get(v, "$", GROUP), F.array().cast(GROUP)))
    tidy = F.transform(
        F.filter(groups, lambda g: F.coalesce(F.trim(g["main"]), F.lit("")) != ""),
        lambda g: F.struct(
            clean_name(g["main"]).alias("main"),
            F.array_distinct(F.filter(F.transform(F.coalesce(g["aliases"], F.array().cast("array<string>")), clean_name), lambda a: (a != "") & (a != clean_name(g["main"])))).alias("aliases"),
            F.coalesce(g["reason"], F.lit("")).alias("reason"),
        ),
    )
    return F.filter(tidy, lambda g: F.size(g["aliases"]) > 0)


def persona_of(reply: Column | str) -> Column:
    """A persona increment of a reply; a lone string or object where a list belongs is a list of one. Null if it isn't
    an object."""
    return once(parsed(unfenced(reply)), _increment)


def _increment(v: Column) -> Column:
    text = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")).alias(k)
    pairs = "array<struct<target:string,change:string>>"
    quotes = "array<struct<field:string,text:string,confidence:string>>"
    changes = "array<struct<field:string,`from`:string,`to`:string,reason:string>>"

    def listed(key: str, kind: str) -> Column:
        one = F.try_variant_get(v, f"$.{key}", kind[6:-1])
        empty = F.array().cast(kind)
        return F.coalesce(F.try_variant_get(v, f"$.{key}", kind), F.when(one.isNotNull(), F.array(one)), empty).alias(key)

    made = F.struct(
        *(text(k) for k in ("personality", "desire", "flaw", "secret", "speech_style")), listed("relationships", pairs), listed("quotes", quotes),
        listed("speech_samples", "array<string>"), listed("changes", changes),
    )
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), made)


def cached_tokens(usage: Column) -> Column:
    """Cached prompt tokens of a usage object, whichever of the known places has them."""
    paths = ("$.prompt_tokens_details.cached_tokens", "$.prompt_cache_hit_tokens", "$.cache_read_input_tokens")
    return once(parsed(usage), lambda v: F.coalesce(*(F.try_variant_get(v, p, "bigint") for p in paths), F.lit(0)))


def names_stub(prompt: str) -> dict:
    """A deterministic stand-in for tests: the capitalised words of a prompt as JSON."""
    found = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", prompt, re.ASCII)))
    return {"content": json.dumps({"characters": found}), "prompt_tokens": len(prompt) // 4, "completion_tokens": len(found)}

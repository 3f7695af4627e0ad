"""Searches of whole texts in Arrow batches, by plain finds of a few words and a pattern round their places only.

A pattern that needs one of some words can only match near one: texts are cut to the windows round these places, those
that meet are one, and what a pattern finds in all windows is what it finds in the text, place by place. So a text costs a
few finds, however seldom its places are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_arrow

Rows = Callable[[str], list[tuple]]


def windows(text: str, words: tuple[str, ...], before: Callable[[str, int], int], after: Callable[[str, int], int]) -> list[list[int]]:
    """Spans ``[start, end]`` round all places of the words, from ``before`` a place to ``after`` its end, in order."""
    spans = []
    for word in words:
        at = text.find(word)
        while at >= 0:
            spans.append((max(0, before(text, at)), after(text, at + len(word))))
            at = text.find(word, at + 1)
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def matches(text: str, pattern: re.Pattern, spans: list[list[int]]) -> Iterator[re.Match]:
    """The matches in windows; places are those in the text."""
    for start, end in spans:
        yield from pattern.finditer(text, start, end)


def found_in(texts: DataFrame, find: Rows, kinds: str) -> DataFrame:
    """``texts`` without ``text``, a row for each that ``find`` returns of a text, whose columns are ``kinds``."""
    bounded_arrow(texts.sparkSession)
    own = [c for c in texts.columns if c != "text"]
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k, text in enumerate(batch.column("text")):
                got = find(text.as_py())
                rows += got
                at += [k] * len(got)
            if not rows:
                continue
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in zip(zip(*rows), types))], [*own, *names])

    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in own), *(f"`{x}` {k.split()[1]}" for x, k in zip(names, kinds.split(", ")))])
    # Java shows bytes that aren't UTF-8 as U+FFFD, Arrow refuses them
    valid = texts.where("text is not null").select(*own, F.make_valid_utf8("text").alias("text"))
    return valid.mapInArrow(run, schema)

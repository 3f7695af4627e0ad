"""Column functions over text, all built from Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends, U+3000 included."""
    return F.btrim(col(c), F.lit(rules.WHITE))


def unicode_spaces(pattern: str) -> str:
    """A pattern whose ``\\s`` stands for white space of all scripts, inside character classes and outside."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            token = pattern[k : k + 2]
            out.append((rules.SPACE if inside else f"[{rules.SPACE}]") if token == r"\s" else token)
            k += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        k += 1
    return "".join(out)


def unix_newlines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "\r\n?", "\n")


def is_ad_line(line: Column | str, patterns: tuple[str, ...] = rules.AD_PATTERNS) -> Column:
    """Whether a line is one that a site added: an address alone, or one of the patterns."""
    line, found = col(line), F.lit(False)
    for p in (rules.URL_LINE, *patterns):
        found = found | line.rlike(p)
    return found


def clean_text(text: Column | str, patterns: tuple[str, ...] = rules.AD_PATTERNS) -> Column:
    """Lines without trailing space and without added lines; one blank line at most between others; idempotent."""
    lines = F.transform(F.split(unix_newlines(text), "\n", -1), lambda x: F.rtrim(x, F.lit(rules.WHITE)))
    kept = F.filter(lines, lambda x: ~is_ad_line(x, patterns))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def chapter_title(line: Column | str) -> Column:
    """The heading that a line is, or null."""
    s = strip(line)
    tail, suffix = F.regexp_extract(s, rules.NUMBERED_HEADING, 1), F.regexp_extract(s, rules.SPECIAL_HEADING, 1)
    sentence = lambda c: c.rlike(rules.TITLE_PUNCTUATION)
    numbered = ~tail.rlike(f"^[{rules.UNITS}]") & ~tail.rlike(rf"^(?:{'|'.join(rules.FALSE_FRIENDS)})(?=[一-鿿])") & ~sentence(tail)
    special = ~(suffix.rlike("^[一-鿿]") & (F.length(suffix) > rules.SPECIAL_SUFFIX)) & ~sentence(suffix)
    return (
        F.when((s == "") | (F.length(s) > rules.HEADING_LINE), None)
        .when(s.rlike(rules.NUMBERED_HEADING), F.when(numbered, s))
        .when(s.rlike(rules.SPECIAL_HEADING), F.when(special, s))
    )


def is_separator(line: Column | str) -> Column:
    return strip(line).rlike(rules.SEPARATOR_LINE)


def chunks(text: Column | str, length: int, ends: str = rules.SENTENCE_ENDS) -> Column:
    """Pieces of at most ``length`` characters, cut behind the last sentence end that fits, or hard; none is empty."""
    if length <= 1:
        raise ValueError("length must be over 1")
    kind = ends.replace("\n", r"\n").replace("]", r"\]")
    pattern = rf"(?s)(.{{1,{length - 1}}}\z|.{{0,{length - 1}}}[{kind}]|.{{{length}}})"
    return F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(pattern), 1), strip), lambda x: x != "")


def paragraphs(text: Column | str, longest: int = 1200) -> Column:
    """Blocks between blank lines; if the longest is too long, lines instead. Empty ones go."""
    tidy = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    blocks = tidy(F.split(col(text), r"\n\s*\n", -1))
    long = F.coalesce(F.array_max(F.transform(blocks, F.length)), F.lit(0)) > longest
    return F.when(long, tidy(F.split(col(text), "\n", -1))).otherwise(blocks)


def sentences(text: Column | str, least: int = 4) -> Column:
    """Sentences with their end, in order, of ``least`` characters at least once stripped."""
    found = F.regexp_extract_all(col(text), F.lit("[^。！？!?\n]+[。！？!?]?"), 0)
    return F.filter(F.transform(found, strip), lambda x: F.length(x) >= least)


def display_width(c: Column | str) -> Column:
    """Two for characters above U+2E80, else one."""
    return F.length(col(c)) + F.length(F.regexp_replace(col(c), "[\\x00-\\u2E80]", ""))


def simplified(c: Column | str) -> Column:
    return F.translate(col(c), rules.TRADITIONAL, rules.SIMPLIFIED)


def traditional(c: Column | str) -> Column:
    return F.translate(col(c), rules.SIMPLIFIED, rules.TRADITIONAL)


def fingerprint(title: Column | str, pieces: Column | str) -> Column:
    """Sixteen hex digits of the SHA-1 of a title and its pieces, separated by U+0000."""
    return F.substring(F.sha1(F.concat_ws("\x00", col(title), col(pieces)).cast("binary")), 1, 16)


def content_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("␟", *map(col, parts)).cast("binary")), 1, 16))


#: The characters of ``rules.IGNORED_IN_QUOTES``: taking them out one by one is faster than by a class of so many ranges.
_IGNORED = [k for k in range(0x10000) if not 0xD800 <= k < 0xE000 and re.fullmatch(unicode_spaces(rules.IGNORED_IN_QUOTES), chr(k))]


def for_matching(c: Column | str) -> Column:
    """Text without white space and punctuation, for comparing quotes."""
    return F.translate(F.coalesce(col(c), F.lit("")), "".join(map(chr, _IGNORED)), "")


def grounded(quote: Column, source: Column) -> Column:
    """Whether a normalised quote stands in a normalised source; an empty one never does."""
    return (F.length(quote) > 0) & F.contains(source, quote)


def quote_field(c: Column | str) -> Column:
    return F.split_part(col(c), F.lit("@ch"), F.lit(1))


def safe_id(c: Column | str) -> Column:
    """A file-safe identifier; an empty one is an error."""
    name = F.btrim(strip(F.translate(col(c), '\\/:*?"<>|', "")), F.lit("."))
    return F.when(F.length(name) > 0, name).otherwise(F.raise_error(F.lit("identifier is empty")))


def book_id(path: Column | str, content: Column | str) -> Column:
    """The file's stem without decoration, or a digest of the content where nothing is left."""
    stem = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")
    trim = lambda c: F.btrim(c, F.lit(rules.BOOK_ID_TRIM))
    slug = F.substring(trim(F.regexp_replace(trim(stem), r'(?U)[\\/:*?"<>|\s]+', "_")), 1, rules.BOOK_ID_LENGTH)
    return F.when(F.length(slug) > 0, slug).otherwise(F.concat(F.lit("book_"), F.substring(F.sha1(col(content).cast("binary")), 1, 12)))


def render(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace the declared ``{names}`` only; other braces stay."""
    out = col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def preview(c: Column | str, length: int = 40) -> Column:
    c = col(c)
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("…"))).otherwise(c)


def iso_timestamp(c: Column | str) -> Column:
    """A time to the second with its offset, in the session's zone."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ssxxx")


def clean_name(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(" \t\r\n　\"'“”‘’《》〈〉「」『』【】()（）[]"))

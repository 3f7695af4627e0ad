"""Sources: raw text files of unknown encoding, JSON and JSON-lines files with damaged rows, prompt templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.model import parsed
from ..runtime import bounded_arrow

#: Tried strictly in this order once no byte-order mark and no UTF-16 pattern is found (fixed values).
ENCODINGS = ("utf-8", "gb18030", "big5")


def looks_like_utf16(data: bytes) -> str | None:
    """The byte order of UTF-16 without a mark: over four fifths of the bytes at one parity are zero."""
    head = data[:512]
    if len(head) < 16:
        return None
    for parity, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        part = head[parity::2]
        if part.count(0) > 0.8 * len(part):
            return name
    return None


def detect(data: bytes) -> tuple[str, int]:
    """``(encoding, bytes of the mark)``; the fallback is GB18030."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig", 3
    if data.startswith(b"\xff\xfe"):
        return "utf-16-le", 2
    if data.startswith(b"\xfe\xff"):
        return "utf-16-be", 2  # decoded in its own byte order
    if found := looks_like_utf16(data):
        return found, 0
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name, 0
        except UnicodeDecodeError:
            continue
    return "gb18030", 0


def decode(data: bytes, encoding: str | None = None) -> tuple[str, str]:
    """Text and encoding; never fails: what can't be decoded is replaced."""
    name, mark = (encoding, 0) if encoding else detect(data)
    try:
        return data[mark:].decode("utf-8" if name == "utf-8-sig" else name), name
    except (UnicodeDecodeError, LookupError):
        return data.decode("gb18030", errors="replace"), "gb18030"


def decoded(raw: DataFrame) -> DataFrame:
    """``(book_id, path, encoding, text, char_count)`` of ``(path, content)``, each file read once.

    Valid UTF-8 without a mark is decoded in the JVM: only the bytes of other files go to Python.
    """
    bounded_arrow(raw.sparkSession)
    content = F.col("content").cast("string")
    plain = F.is_valid_utf8(content) & ~F.startswith(F.hex(F.substring("content", 1, 3)), F.lit("EFBBBF")) & ~F.contains(content, F.lit("\x00"))

    @F.pandas_udf("encoding string, text string")
    def other(contents: pd.Series) -> pd.DataFrame:
        found = [(None, None) if c is None else decode(bytes(c)) for c in contents]
        return pd.DataFrame({"encoding": [e for _, e in found], "text": [t for t, _ in found]})

    rows = raw.select("path", "content", plain.alias("plain"))
    rows = rows.withColumn("found", other(F.when(~F.col("plain"), F.col("content"))))
    both = rows.select(
        "path", F.when(F.col("plain"), "utf-8").otherwise(F.col("found.encoding")).alias("encoding"),
        T.clean_text(F.when(F.col("plain"), content).otherwise(F.col("found.text"))).alias("text"),
    )
    return both.select(T.book_id("path", "text").alias("book_id"), "path", "encoding", "text", F.length("text").alias("char_count"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as variants; damaged ones are null."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parsed("value").alias("value"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the schema; blank and damaged lines, and lines that aren't objects, are left out."""
    lines = spark.read.text(path).where(F.schema_of_variant(parsed("value")).startswith("OBJECT"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_name_caches(spark: SparkSession, path: str) -> DataFrame:
    """``(book_id, chapter_index, fingerprint, chunks)`` of the files ``<book>/chapters/<n>.names.json`` under a folder, by
    chapter; damaged ones are left out, so that their chapters are scanned again.

    ``parts`` of a file is a list of lists, or a flat list for a chapter of one piece.
    """
    rows = spark.read.option("pathGlobFilter", "*.names.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), parsed("value").alias("v"))
    index = F.try_variant_get("v", "$.chapter_index", "int")
    parts = F.to_json(F.try_variant_get("v", "$.parts", "variant"))
    found = rows.select(F.url_decode(F.regexp_extract("file", r"([^/]+)/chapters/[^/]+$", 1)).alias("book_id"), index.alias("chapter_index"), F.try_variant_get("v", "$.fingerprint", "string").alias("fingerprint"), parts.alias("parts"))
    return found.where("chapter_index is not null").select("book_id", "chapter_index", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), canonical_chunks(F.col("parts")).alias("chunks")).orderBy("book_id", "chapter_index")


def canonical_chunks(parts: Column) -> Column:
    """The chunks of a stored JSON value: a list of lists as it is, a flat list as one chunk, an empty list too."""
    v = parsed(parts)
    nested, flat = F.try_variant_get(v, "$", "array<array<string>>"), F.try_variant_get(v, "$", "array<string>")
    deep = F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant")).startswith("ARRAY")
    return F.when(F.coalesce(deep, F.lit(False)), nested).otherwise(F.array(F.coalesce(flat, F.array().cast("array<string>"))))


def template(templates: DataFrame, name: str) -> str:
    """The text of one template; an unknown name is an error that lists the known ones."""
    found = templates.where(F.col("name") == name).select("text").head()
    if found is None:
        raise KeyError(f"no template {name!r}; there are {', '.join(r.name for r in templates.select('name').orderBy('name').limit(50).collect())}")
    return found.text


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """``(name, text)`` of template files, without a comment at their head."""
    rows = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return rows.select(name.alias("name"), F.regexp_replace("value", r"(?s)^\s*(?:<!--.*?-->)?\s*", "").alias("text"))


def complete_texts(raw: DataFrame, end_marker: str) -> DataFrame:
    """Downloads that are whole: valid UTF-8 that holds the end marker."""
    text = F.col("content").cast("string")
    return raw.where(F.is_valid_utf8(text) & F.contains(text, F.lit(end_marker)))

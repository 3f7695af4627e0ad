"""Repositories over Parquet tables in one folder: novels, chapter caches, artefacts, cards, memory and sessions.

A save appends the rows of some units, a book or a chapter's cache, under a new version; a reader takes each unit's last
version. So saves never read or rewrite what others saved, a failed one leaves nothing behind, and a deleted unit is one
whose last version says so. :meth:`Catalog.compact` drops the versions that nobody reads.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from json import dumps, loads

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The columns that name a unit, which a save replaces as a whole. Logs have none: their rows are only ever added.
UNITS: dict[str, tuple[str, ...]] = {
    "books": ("book_id",),
    "chapters": ("book_id",),
    "chapter_names": ("book_id", "chapter_index"),
    "candidates": ("book_id",),
    "alias_groups": ("book_id",),
    "increments": ("book_id", "character"),
    "personas": ("book_id", "character"),
    "cards": ("card_id",),
    "memory": (),
    "session_events": (),
}
#: The folder column of a table: a look-up by it reads that folder only.
FOLDERS = {"chapters": "book_id", "chapter_names": "book_id", "candidates": "book_id", "increments": "book_id", "personas": "book_id"}
#: Names that a table keeps for itself.
VERSION, GONE = "saved_version", "saved_gone"


def card_id(cards: DataFrame) -> Column:
    """The id of a card: its own or its name, as a file-safe one; a card without either is an error."""
    given = F.nullif(F.col("card_id"), F.lit("")) if "card_id" in cards.columns else F.lit(None).cast("string")
    return T.safe_id(F.coalesce(given, F.nullif(F.col("name"), F.lit("")), F.lit("")))


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _all(self, table: str) -> DataFrame | None:
        try:
            rows = self.spark.read.option("mergeSchema", "true").parquet(self.path(table))
        except AnalysisException:
            return None
        folder = FOLDERS.get(table)  # ids that look like numbers are texts all the same
        return rows.withColumn(folder, F.col(folder).cast("string")) if folder else rows

    def _last(self, rows: DataFrame, unit: tuple[str, ...]) -> DataFrame:
        last = rows.groupBy(*unit).agg(F.max(VERSION).alias(VERSION))
        return rows.join(last, [*unit, VERSION], "left_semi").where(~F.col(GONE))

    def load(self, table: str, **keys) -> DataFrame | None:
        """The rows of a table, or those of a key, or None where nothing was ever saved."""
        rows, unit = self._all(table), UNITS.get(table, ())
        if rows is None:
            return None
        for name, value in keys.items():  # before versions are compared: folders are pruned
            if not unit or name in unit:
                rows = rows.where(F.col(name) == value)
        kept = self._last(rows, unit) if unit else rows
        for name, value in keys.items():
            kept = kept.where(F.col(name) == value)
        return kept.drop(VERSION, GONE)

    find = load

    def exists(self, table: str, **keys) -> bool:
        rows = self.load(table, **keys)
        return rows is not None and not rows.isEmpty()

    def ids(self, table: str, key: str | None = None) -> DataFrame | None:
        """The ids of a table in order; by default those of its units' first column."""
        rows, key = self.load(table), key or (UNITS.get(table) or ("character_id" if table == "memory" else "session_id",))[0]
        return None if rows is None else rows.select(key).distinct().orderBy(key)

    def names(self, book_id: str) -> DataFrame | None:
        """The cached names of a book's chapters, by chapter; rows that can't be a cache are left out."""
        rows = self.load("chapter_names", book_id=book_id)
        return None if rows is None else rows.where("chapter_index is not null and chunks is not null").orderBy("chapter_index")

    def _write(self, table: str, rows: DataFrame) -> None:
        writer, folder = rows.write.mode("append"), FOLDERS.get(table)
        (writer.partitionBy(folder) if folder else writer).parquet(self.path(table))

    def save(self, table: str, rows: DataFrame) -> None:
        """Replace the units that ``rows`` holds, or add to a log. Other units, also of the same book, stay."""
        if table == "cards":
            rows = rows.withColumn("card_id", card_id(rows))
        if UNITS.get(table, ()):
            rows = rows.withColumns({VERSION: F.lit(time.time_ns()), GONE: F.lit(False)})
        self._write(table, rows)

    def save_novel(self, books: DataFrame, chapters: DataFrame) -> None:
        self.save("chapters", chapters)
        self.save("books", books)

    def delete(self, table: str, **keys) -> int:
        """Delete the units that the keys name and say how many there were."""
        rows, unit = self.load(table, **keys), UNITS.get(table, ())
        if rows is None:
            return 0
        if not unit:
            return self._clear(table, keys)
        gone = rows.select(*unit).distinct()
        n = gone.count()
        if n:
            self.delete_units(table, gone)
        return n

    def delete_units(self, table: str, units: DataFrame) -> None:
        """Delete all units of a table of their names, whether they are there or not."""
        self._write(table, units.select(*UNITS[table]).distinct().withColumns({VERSION: F.lit(time.time_ns()), GONE: F.lit(True)}))

    def _clear(self, table: str, keys: dict) -> int:
        """Take rows out of a log, which is rewritten beside itself and then put in its place."""
        rows, match = self._all(table), F.lit(True)
        for name, value in keys.items():
            match = match & F.col(name).eqNullSafe(F.lit(value))
        n = rows.where(match).count()
        if n:
            self._replace(table, rows.where(~match))
        return n

    def _replace(self, table: str, rows: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        here, side, old = (jvm.org.apache.hadoop.fs.Path(self.path(table) + x) for x in ("", "-new", "-old"))
        files = here.getFileSystem(conf)
        files.delete(side, True)
        writer, folder = rows.write, FOLDERS.get(table)
        (writer.partitionBy(folder) if folder else writer).parquet(side.toString())
        files.rename(here, old)
        files.rename(side, here)
        files.delete(old, True)

    def compact(self, table: str) -> None:
        """Keep the last version of each unit only. No one else may save meanwhile."""
        rows, unit = self._all(table), UNITS.get(table, ())
        if rows is not None and unit:
            self._replace(table, self._last(rows, unit))


def export_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, added to what is there with mode ``append``."""
    rows.write.mode(mode).json(path)


def export_documents(rows: DataFrame, path: str, name: str = "name", json: str = "json") -> None:
    """Each row's JSON, indented by two and with its characters as they are, in a folder of its file-safe name."""

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else dumps(loads(t), indent=2, ensure_ascii=False))

    rows.select(T.safe_id(name).alias("name"), pretty(json).alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(path)

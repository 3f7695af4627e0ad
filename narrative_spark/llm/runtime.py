"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ARROW_CONF, bounded_arrow, ship_package  # noqa: F401 - part of this module's interface


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Where that setting is absent, a temporary folder of this machine is set if all of Spark runs in this process, as in
    tests; on a cluster it is an error, as executors would write to folders that the others don't see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set; on a cluster it has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="narrative-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """Have a folder that exists deleted when Spark ends."""
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)


def stored(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost no recomputation.

    The table is deleted when Spark ends, if nothing has deleted it before.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.format(fmt).save(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def tidy(spark: SparkSession) -> None:
    """Have Spark drop shuffles and broadcasts that nothing refers to any more: it does so behind a garbage collection of
    the driver, which on its own may come after very many of them."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """The tables that one call of an operator writes on its way. They are deleted at the end of the block, also after
    an error; only the result stays, as a table of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
        tidy(self.spark)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, name)
        self.paths.append(path)
        return stored(df, name, path=path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of ``df``: each as given, with underscores in front until ``df`` has none like it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


#: Rows of a table that is broadcast whole, and bits of the filter that stands for a larger one.
SMALL, FILTER_BITS = 400_000, 1 << 26


def split_by(rows: DataFrame, table: DataFrame, place: Column, place_in: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a partner in ``table``, and those that have none, told apart by a filter of hashed bits.

    The filter is a table of 64-bit words, of ``FILTER_BITS / 64`` rows at most, so it can be broadcast at any size of the
    other; wide rows without a partner need no shuffle.
    """
    at = lambda c: c.bitwiseAND(F.lit(FILTER_BITS - 1))
    here, word, bits = free_names(rows, "filter_place", "filter_word", "filter_bits")
    one = F.lit(1).cast("bigint")
    words = table.select(F.shiftrightunsigned(at(place_in), 6).alias(word), at(place_in).bitwiseAND(F.lit(63)).alias("bit"))
    words = words.select(word, F.call_function("shiftleft", one, F.col("bit").cast("int")).alias("one")).groupBy(word).agg(F.bit_or("one").alias(bits))
    marked = rows.withColumn(here, at(place)).withColumn(word, F.shiftrightunsigned(here, 6)).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.getbit(bits, F.col(here).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def narrow_join(rows: DataFrame, table: DataFrame, on: Column, how: str, place: Column, place_in: Column) -> DataFrame:
    """Join wide ``rows`` to a narrow ``table``, ``inner``, ``left_semi`` or ``left_anti``, without a shuffle of the rows
    that have no partner: a small table is broadcast, a larger one after a filter of its hashes has gone ahead."""
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table), on, how)
    maybe, never = split_by(rows, table, place, place_in)
    met = maybe.join(table, on, how)
    return met.unionByName(never) if how == "left_anti" else met


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` made, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

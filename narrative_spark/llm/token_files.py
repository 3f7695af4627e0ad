"""Token-id output: ORC stripes with run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoding import encoder
from .runtime import bounded_arrow, shared_dir, stored, until_exit

#: ORC settings. Ids go out as run-length encoded integers; the row index has an entry for each stride of rows, and a
#: Bloom filter of document ids in each entry lets a reader skip strides and stripes by metadata alone.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, n_tokens, ids)`` with the end id appended. A null text is empty and has the end id only.

    ``row`` numbers the rows of a partition in the order in which they come.
    """
    bounded_arrow(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        byte_level, row = encoder("byte", tokenizer), 0
        for batch in batches:
            encoded = [ids + end for ids in byte_level.encode(t or "" for t in batch.column(1).to_pylist())]
            counts = np.fromiter((len(x) // 4 for x in encoded), dtype="<i4", count=len(encoded))
            flat = pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"), pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + len(encoded), dtype="<i8")), pa.array(counts.astype("<i8")), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "row", "n_tokens", "ids"],
            )
            row += len(encoded)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, row bigint, n_tokens bigint, ids array<int>"
    )


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write ORC files under ``path``, in ascending order of the document id over all files.

    Texts are range-partitioned by id before they are encoded, so that ids are never shuffled; the file number follows
    the order. Rows that share an id stand in the order of their text's hash, then of the text, so that an id which very
    many rows share is dealt over several files, and equal input gives equal files. Each task streams; no document list
    is gathered anywhere.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    encode_documents(ordered, tokenizer, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The rows of the files; a filter on ``doc_id`` reaches stripe statistics and Bloom filters."""
    return spark.read.schema(f"doc_id {id_type}, row bigint, n_tokens bigint, ids array<int>").option("mergeSchema", "false").orc(path)


def token_table(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the files.

    ``start`` is the number of ids of all documents before: running sums within blocks of the file order plus the sums
    of the blocks before. The table of block sums has one row a file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists = batch.column(3)
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.values, dtype="<u4")
            base = int(ends[0])
            values = flat.tobytes() if base == 0 else flat[base:].tobytes()
            crcs = [zlib.crc32(values[4 * (int(a) - base) : 4 * (int(b) - base)]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype("<i8")), pa.array(crcs, pa.int64()), batch.column(4)],
                names=["doc_id", "row", "n_tokens", "ids_crc32", "file"],
            )

    files = read_token_files(spark, path, id_type).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
    rows = files.mapInArrow(digest, f"doc_id {id_type}, row bigint, n_tokens bigint, ids_crc32 bigint, file int")
    return prefix_starts(stored(rows, "token-digest"))


def prefix_starts(rows: DataFrame) -> DataFrame:
    """Rows ``(doc_id, row, n_tokens, ids_crc32, file)`` with ``start``, in the order of file and row."""
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(sums, rows.file == sums.f).select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_table(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return the table read back from them.

    Null texts are empty: one end id. Rows that share an id are adjacent, in the order of their text's hash; ``start``
    follows the order of the files. An empty table gives no rows. Extra columns are ignored. Files without a ``path`` of
    the caller are deleted when Spark ends.
    """
    spark = docs.sparkSession
    own = path or shared_dir(spark, "tokens")
    write_token_files(docs, own, tokenizer, end_id)
    if path is None:
        until_exit(spark, own)
    return token_table(spark, own, docs.schema["doc_id"].dataType.simpleString())

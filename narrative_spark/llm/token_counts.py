"""Token counts: lengths only, from batch encoding in Arrow functions, with batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import MEMO_KEY, WordEncoder, by_bytes, cut_here, encoder, safe_pieces, tokenizer_path
from .runtime import bounded_arrow

BATCH_BYTES = 1 << 20
#: Entries of the memo of lengths.
ENTRIES = 600_000
_LOADED: dict[str, "PieceCounts | TextCounts"] = {}


class PieceCounts:
    """For vocabularies that drop white space: a text has the tokens of its pieces between ASCII white space.

    The distinct pieces of a batch that aren't known yet go to the library's batch encoding; of what it returns, only
    lengths are kept. The memo of lengths is bounded; once it is full, other pieces are encoded once a batch.
    """

    def __init__(self, name: str, most: int = ENTRIES):
        self.encoder, self.known, self.most = WordEncoder(tokenizer_path(name), 0), {}, most

    def lengths(self, fresh: set[bytes]) -> dict[bytes, int]:
        return {p: len(ids) // 4 for p, ids in self.encoder.fresh(fresh).items()}

    def count(self, texts: list[bytes], batch_bytes: int) -> list[int]:
        """Tokens of each text. Longer texts are split at white space, so that no batch holds much more than
        ``batch_bytes``, and their parts' counts are added up."""
        parts, owners = [], []
        for k, text in enumerate(texts):
            for part in (text,) if len(text) <= batch_bytes else safe_pieces(text, batch_bytes):
                parts.append(part)
                owners.append(k)
        counts = [0] * len(texts)
        for start, end in by_bytes(list(map(len, parts)), batch_bytes):
            split = [p.split() for p in parts[start:end]]
            met = set().union(*split)
            found = self.lengths({p for p in met if p not in self.known})
            short = {p: n for p, n in found.items() if len(p) <= MEMO_KEY}
            if len(self.known) + len(short) <= self.most:
                self.known.update(short)
                table = self.known if len(short) == len(found) else self.known | found
            else:
                table = {p: self.known[p] for p in met if p in self.known} | found
                for p in list(short)[: max(0, self.most - len(self.known))]:
                    self.known[p] = short[p]
            for k, pieces in zip(owners[start:end], split):
                counts[k] += sum(map(table.__getitem__, pieces))
        return counts


class TextCounts:
    """For all other vocabularies, whose texts can't be cut: each goes through its library whole."""

    def __init__(self, name: str):
        self.encoder = encoder("word", name)

    def count(self, texts: list[bytes], batch_bytes: int) -> list[int]:
        return [len(ids) // 4 for ids in self.encoder.encode(texts)]


def counter(name: str) -> "PieceCounts | TextCounts":
    """The counter of this Python process."""
    if name not in _LOADED:
        path = tokenizer_path(name)
        _LOADED[name] = PieceCounts(name) if cut_here("word", path) else TextCounts(name)
    return _LOADED[name]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_tokens, over_limit)``, one per input row, without special tokens of the caller.

    The function returns lengths only: ids never leave the worker. Batches hold about ``batch_bytes`` of text whatever
    the number of rows, and a longer text is counted in parts cut at ASCII white space, where the pre-tokenizer cuts
    too, so that the sum is exact; that holds for files whose own settings say so, texts of others are counted whole.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; extra columns are dropped; an empty
    table gives an empty result.
    """
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(tokenizer)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            counts = words.count(texts, batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )

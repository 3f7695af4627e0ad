"""Corpus pipeline over ``documents``: each stage's result is written and read again as the next one's input.

Language identification, toxicity, near-duplicate removal, benchmark decontamination, then packing into training
sequences. Each stage decides over all rows that the one before kept; all but the last return the columns of documents,
extra ones included, and keep or drop a row by its text, never by an id that other rows may share. An empty table passes
all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narrative_spark.llm.decontaminate import drop_contaminated
from narrative_spark.llm.language_id import keep_identified
from narrative_spark.llm.packing import pack_documents
from narrative_spark.llm.queries import WORD_VOCABULARY
from narrative_spark.llm.runtime import stored
from narrative_spark.llm.simhash import keep_one
from narrative_spark.llm.toxicity import drop_toxic


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null and empty texts and texts without a letter go.

    Whole texts are judged, of any length, equal ones alike. A tie goes to the first language by name, so no document
    with letters is lost to it; where no row has a language to learn, all texts with letters stay.
    """
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model learns from the labels of documents that got here.

    Whole texts are scored, of any length, equal ones alike; null, empty and wordless texts have the score of no
    evidence and stay. A score of just 0.3 is rejected. Without labels of both kinds nothing is.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts with a five-word Jaccard similarity of 0.8 or more.

    Links are found by SimHash and checked on whole texts. Null and wordless texts are copies of each other. Of rows
    with equal id and text one stays; rows that share an id with other texts are judged apart, rows without an id come
    last; ties of ids are settled by the text's digest.
    """
    return keep_one(docs, width=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item, nor all of an item of fewer words.

    Null, empty and wordless texts hold none and stay, as do all without items; equal texts are judged alike.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 4096 tokens.

    A null or empty text is its end id alone; longer texts than a sequence are cut; repeated rows are packed each.
    """
    return pack_documents(docs, WORD_VOCABULARY, end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Models and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

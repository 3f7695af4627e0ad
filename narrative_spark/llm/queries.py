"""The queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate
from .decontaminate import contamination
from .html_text import extract_pages
from .language_id import identify
from .matroska import media_table
from .packing import pack_documents
from .runtime import table
from .sharding import shard
from .simhash import near_duplicates
from .token_counts import count_tokens
from .token_files import token_file_table
from .toxicity import score_documents

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=24)


def op3_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_table(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=2)


def op4_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_table(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=1, capacity=4096)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, distance=4)


def op8_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op9_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY, limit=2048)


QUERIES = {f.__name__: f for f in (op1_crf_toxicity, op2_minimax_shards, op3_orc_token_files, op4_matroska_packets, op5_best_fit_packing, op6_main_text, op7_simhash_groups, op8_benchmark_index, op9_cross_parsing_language, op10_token_counts)}
ORACLES: dict[str, str] = {"op8_benchmark_index": decontaminate.ORACLE}

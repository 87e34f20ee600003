"""One query per operator over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairworks.llm import (
    byte_bpe, exact_topk, fill_middle, language, line_dedup, mixing, near_dedup, one_bit_index, prefix_trie, quality,
    secret_scan, token_counts, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string")) % divisor


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.fit_and_score(_table(spark, folder, "documents"), _table(spark, folder, "labels"),
                                 _remainder("doc_id", 5) == 0)


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_decode(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.learn_and_identify(_table(spark, folder, "documents"), _remainder("doc_id", 3) == 1)


def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_one_bit_index(spark: SparkSession, folder: str) -> DataFrame:
    return one_bit_index.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents")).drop("tag")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(_table(spark, folder, "documents"))


def op9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(_table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, folder, "conversations"))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.report(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality, "op2_byte_bpe": op2_byte_bpe, "op3_language": op3_language,
    "op4_exact_topk": op4_exact_topk, "op5_one_bit_index": op5_one_bit_index,
    "op6_token_counts": op6_token_counts, "op7_near_dedup": op7_near_dedup, "op8_secrets": op8_secrets, "op9_mix": op9_mix, "op10_warc": op10_warc,
    "op11_line_dedup": op11_line_dedup, "op12_prefix_trie": op12_prefix_trie, "op13_fill_middle": op13_fill_middle,
}

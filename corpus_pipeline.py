"""A corpus from documents: language, near duplicates, secrets, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairworks.llm import byte_bpe, language, mixing, near_dedup, secret_scan
from pairworks.llm.common import fresh_name, materialise


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from four fifths of the rows with a language, and the least score of each language and length
    from the others; drops documents that fit no language, those that reach no such score included."""
    held_out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    profiles = language.learn(docs.filter(~held_out))
    return language.accepted(docs, profiles, language.learn_least_scores(docs.filter(held_out), profiles))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return near_dedup.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret, and keys that stick out of one, replaced by a mark; n_chars follows the text."""
    before = fresh_name(docs, "before")
    hidden = secret_scan.redact(docs.withColumn(before, F.length("text")), overhang=True)
    changed = ~F.length("text").eqNullSafe(F.col(before))
    return hidden.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it, in the order of its schedule."""
    return mixing.copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to, a row per document of the mixture."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", keep_known_languages), ("near duplicates", keep_one_of_each), ("secrets", hide_secrets),
          ("mixture", mix_sources), ("byte-level BPE", encode)]

# Rank-order profiles, a similarity join and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

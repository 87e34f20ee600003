"""Exact-duplicate and blank removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.functions.text import digest, py_strip
from pairworks.plans.running import group_key
from pairworks.plans.shared import materialise


def dedupe_pairs(
    df: DataFrame, keys: tuple[str, ...] = ("dataset",), order: str = "sample_id"
) -> DataFrame:
    """The first row by `order` of every distinct (keys, input, target), untrimmed.

    Only keys, digests and orders are stored and shuffled to find the rows that go; whole rows
    are compared with those where they lie, or meet them on (key, digest, order), which seldom
    repeats. No text is sorted. A row without an order comes after all that have one; of copies
    with the same order any may stay, and only such copies are reduced as whole rows.
    `df` is read twice.
    """
    on = ["_g", "_digest"]
    tagged = df.withColumns({
        "_g": group_key(list(keys)), "_digest": digest(F.col("input"), F.col("target")), "_order": F.col(order)})
    narrow = materialise(tagged.select(*on, "_order"), "pair-digests")
    # _first is null where no copy has an order.
    copied = materialise(
        narrow.groupBy(*on).agg(F.count("*").alias("_copies"), F.min("_order").alias("_first"))
        .filter("_copies > 1").drop("_copies"), "copied-pairs")
    copies = narrow.join(copied, on)
    is_first = F.col("_order").eqNullSafe(F.col("_first"))
    losers = materialise(copies.filter(~is_first).select(*on, "_order"), "lost-copies")
    tied = materialise(
        copies.filter(is_first).groupBy(*on).agg(F.count("*").alias("_copies"))
        .filter("_copies > 1").select(*on), "tied-copies")
    kept = _without(tagged, losers, [*on, "_order"])
    if not tied.isEmpty():
        again = kept.join(tied, on, "left_semi").dropDuplicates(on)
        kept = kept.join(tied, on, "left_anti").unionByName(again)
    return kept.select(*df.columns)


def _without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """The rows with no partner; nulls are equal."""
    renamed = others.select(*[F.col(c).alias(f"_x{c}") for c in on])
    return rows.join(
        renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_x{c}")) for c in on]), "left_anti")


def not_blank() -> Column:
    """Whether both texts hold more than whitespace; null counts as blank."""
    return F.coalesce(
        (py_strip(F.col("input")) != "") & (py_strip(F.col("target")) != ""), F.lit(False))


def drop_blank(df: DataFrame) -> DataFrame:
    return df.filter(not_blank())


def clean(
    df: DataFrame, keys: tuple[str, ...] = ("dataset",), order: str = "sample_id"
) -> DataFrame:
    """Blank rows go first: copies of a pair are all blank or all not, and they need no shuffle."""
    return dedupe_pairs(drop_blank(df), keys, order)


def clean_stats(df: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Rows before, removed and left per dataset; shuffles digests and counts, no texts."""
    pairs = df.groupBy(
        *keys, digest(F.col("input"), F.col("target")).alias("_digest"), not_blank().alias("_full")
    ).agg(F.count("*").alias("_copies"))
    return pairs.groupBy(*keys).agg(
        F.sum("_copies").alias("initial"),
        (F.sum("_copies") - F.count_if("_full")).alias("removed"),
        F.count_if("_full").alias("count"))


def write_clean(
    df: DataFrame, path: str, version: str, keys: tuple[str, ...] = ("dataset",),
    order: str = "sample_id",
) -> DataFrame:
    """The cleaned rows as a new version below `path`; the input version stays as it is."""
    target = f"{path}/version={version}"
    cleaned = clean(df, keys, order)
    cleaned.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(cleaned.schema).parquet(target)

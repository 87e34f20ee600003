"""Exact positions within a key without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairworks.plans.running import group_key
from pairworks.plans.shared import materialise

FINE_BITS = 16
BLOCK_ROWS = 200_000
KEYS_TO_BROADCAST = 1_000_000


def shuffle_key(seed: int | str, row_id: str) -> Column:
    """A repeatable random order: the MD5 of seed and row id, as hex text.

    A row without an id has no place in it and would vanish without an error: it fails the job.
    """
    known = F.coalesce(F.col(row_id).cast("string"), F.raise_error(F.lit(f"a row has no {row_id}")).cast("string"))
    return F.md5(F.concat(F.lit(f"{seed}:"), known))


def fine_bucket(key: Column) -> Column:
    """The first 16 bits of a hex key; rows spread evenly over the 65,536 buckets."""
    return F.conv(F.substring(key, 1, FINE_BITS // 4), 16, 10).cast("int")


def quota_cuts(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: dict[str, Column],
    quota: Callable[[Column], Column],
) -> DataFrame:
    """The row at position quota(n) of every key with n rows, as one row per key.

    `bucket` must rise with `order`. Buckets are counted first; then only the one bucket that
    holds the wanted row is ranked, so the sort touches a sliver of the rows and the caller can
    compare wide rows with the cut where they lie instead of shuffling them. Returns the keys,
    n, quota and `cut_*` per order column; a key whose quota is 0 has no row. `tie_rows` rows have
    the order of the cut, of which `tie_take` lie within the quota.
    """
    narrow = df.select(*keys, bucket.alias("_bucket"), *[c.alias(o) for o, c in order.items()])
    counts = narrow.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    group = Window.partitionBy(group_key(keys))
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sized = (
        counts
        .withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("n", F.sum("_rows").over(group))
        .withColumn("quota", quota(F.col("n")).cast("bigint"))
    )
    wanted = materialise(
        sized.filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_rows") < F.col("quota")))
        .select(*keys, "_bucket", "n", "quota",
                (F.col("quota") - F.col("_upto") + F.col("_rows")).alias("_need")),
        "wanted-buckets", KEYS_TO_BROADCAST,
    ).withColumn("_g", group_key(keys)).drop(*keys)
    inside = narrow.withColumn("_g", group_key(keys)).join(wanted, ["_g", "_bucket"])
    in_order = Window.partitionBy("_g").orderBy(*order)
    placed = inside.withColumns({"_pos": F.row_number().over(in_order), "_first": F.rank().over(in_order)})
    return materialise(
        placed.withColumn("_tied", F.count("*").over(Window.partitionBy("_g", *order))).filter(F.col("_pos") == F.col("_need"))
        .select(*keys, "n", "quota", *[F.col(o).alias(f"cut_{o}") for o in order],
                F.col("_tied").alias("tie_rows"), (F.col("_pos") - F.col("_first") + 1).cast("bigint").alias("tie_take")),
        "cuts", KEYS_TO_BROADCAST,
    )


def at_or_before(order: dict[str, Column]) -> Column:
    """Whether a row lies at or before the cut of its key; false where there is no cut."""
    names = list(order)
    cut = F.struct(*[F.col(f"cut_{o}").alias(o) for o in names])
    here = F.struct(*[order[o].alias(o) for o in names])
    return F.coalesce(F.col(f"cut_{names[0]}").isNotNull() & (here <= cut), F.lit(False))


def in_broken_tie(order: dict[str, Column]) -> Column:
    """Whether a row has the order of its key's cut, and so do others of which only some lie within the quota."""
    same = F.lit(True)
    for o, here in order.items():
        same = same & here.eqNullSafe(F.col(f"cut_{o}"))
    return F.coalesce((F.col("tie_rows") > F.col("tie_take")) & same, F.lit(False))


def with_cuts(df: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with its key's cut; broadcast when the cuts are small, see `materialise`.

    Without keys there is one cut at most: it is put into the plan as literals, without a join.
    """
    if not keys:
        row = cuts.first()
        return df.withColumns({
            f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in cuts.schema.fields})
    return df.withColumn("_g", group_key(keys)).join(
        cuts.withColumn("_g", group_key(keys)).drop(*keys), "_g", "left").drop("_g")


def global_rank(
    df: DataFrame, keys: list[str], row_id: str, seed: int | str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds each row's 1-based `rank` in a repeatable shuffle of its key.

    A key of n rows is cut by its hash into about n / block_rows blocks; blocks are ranked apart
    and offset by the sizes of the blocks before them. The rows of a block lie in one partition
    afterwards. Also adds `_n`, `_block`, `_offset` and `_block_size`.
    """
    bits = F.least(F.lit(FINE_BITS), F.greatest(
        F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(block_rows))))).cast("int")
    sizes = materialise(
        df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_bits", bits), "key-sizes",
        KEYS_TO_BROADCAST,
    ).withColumn("_g", group_key(keys)).drop(*keys)
    keyed = (
        df.withColumn("_g", group_key(keys)).join(sizes, "_g")
        .withColumn("_key", shuffle_key(seed, row_id))
        .withColumn("_block", F.call_function(
            "shiftright", fine_bucket(F.col("_key")), F.lit(FINE_BITS) - F.col("_bits")))
    )
    before = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(
        keyed.groupBy("_g", "_block").agg(F.count("*").alias("_block_size"))
        .withColumn("_offset", F.coalesce(F.sum("_block_size").over(before), F.lit(0))),
        "blocks",
    )
    within = Window.partitionBy("_g", "_block").orderBy("_key", row_id)
    return (
        keyed.withColumn("_pos", F.row_number().over(within))
        .join(blocks, ["_g", "_block"])
        .withColumn("rank", F.col("_offset") + F.col("_pos"))
        .select(*df.columns, "rank", "_g", "_n", "_block", "_offset", "_block_size")
    )

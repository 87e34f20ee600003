"""Ordered computations within a key that stay parallel when one key holds most rows.

A plain window hands all rows of a key to one task. Keys with more than `chunk` rows are found
first (there can be no more than rows / chunk of them) and cut along their order, by counted rows,
into chunks; a task then sees one chunk, and only a summary row per chunk crosses chunk borders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairworks.plans.shared import materialise

CHUNK = 1 << 20
FEWEST_CELLS = 8

_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "min": F.least,
    "max": F.greatest,
}


def group_key(keys: list[str]) -> Column:
    """The key columns as one struct: unlike bare columns, structs with nulls in them are equal."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def long_keys(
    df: DataFrame, keys: list[str], order: str, chunk: int = CHUNK
) -> list[DataFrame] | None:
    """Where keys with more than `chunk` rows are cut, level by level; None if there are none.

    `order` is a whole number. A long key is cut into cells of equal width, rows are counted per
    cell, and a cell that still holds more than `chunk` rows is cut again, until none does or its
    rows all have one order. Outliers and gaps so cost a level and never fill a chunk. There are
    at most about max(FEWEST_CELLS, 2 * rows / chunk) cells per cell that is cut.
    """
    rows = _uncut(df.select(group_key(keys).alias("_g"), F.col(order).alias("_at")))
    cells = rows.groupBy("_g").agg(
        F.count("*").alias("_n"), F.min("_at").cast("bigint").alias("_cell_start"),
        (F.max("_at") - F.min("_at") + 1).cast("bigint").alias("_span"))
    levels: list[DataFrame] = []
    while True:
        step = F.expr(f"_span div greatest({FEWEST_CELLS}, 2 * _n div {chunk}) + 1")
        level = materialise(
            cells.filter((F.col("_n") > chunk) & (F.col("_span") > 1)).select("_g", "_cell_start", step.alias("_cell_width")),
            "long-keys")
        if level.isEmpty():
            return levels or None
        rows = _descend(rows, "_at", level, not levels, "inner")
        if levels:
            rows = materialise(rows, "long-rows")
        levels.append(level)
        cells = rows.groupBy("_g", F.col("_chunk").alias("_cell_start"), F.col("_width").alias("_span")).agg(
            F.count("*").alias("_n"))


def _uncut(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_width": F.lit(None).cast("bigint"), "_chunk": F.lit(0).cast("bigint")})


def _descend(rows: DataFrame, order: str, level: DataFrame, first: bool, how: str) -> DataFrame:
    """Rows in cells that `level` cuts get the smaller cell: `_chunk`, where it starts, and `_width`.

    A row without an order lies in the first cell.
    """
    side = level if first else level.withColumn("_chunk", F.col("_cell_start"))
    start = F.expr(f"_cell_start + (CAST(`{order}` AS bigint) - _cell_start) div _cell_width * _cell_width")
    return rows.join(side, ["_g"] if first else ["_g", "_chunk"], how).withColumns({
        "_chunk": F.coalesce(start, F.col("_cell_start"), F.col("_chunk")),
        "_width": F.coalesce("_cell_width", "_width")}).drop("_cell_start", "_cell_width")


def cut(
    df: DataFrame, keys: list[str], order: str, long: list[DataFrame] | None
) -> DataFrame:
    """Adds `_g`, `_width` and `_chunk`. A key that is not long is all chunk 0, without a width.

    `long` comes from `long_keys`. The chunks of a key are numbered by the order they start at.
    """
    rows = _uncut(df.withColumn("_g", group_key(keys)))
    for number, level in enumerate(long or []):
        rows = _descend(rows, order, level, number == 0, "left")
    return rows


def running(
    chunks: DataFrame,
    order: str,
    folds: dict[str, tuple[str, str]],
    inclusive: bool = True,
    long: list[DataFrame] | None = None,
) -> DataFrame:
    """Adds `{out: (fold, column)}`: sum, min or max over the rows up to this one in its key.

    The row itself counts if `inclusive`. `chunks` comes from `cut` and keeps its columns, so
    that one shuffle and sort serve any number of steps.
    """
    before, end = Window.unboundedPreceding, 0 if inclusive else -1
    within = Window.partitionBy("_g", "_chunk").orderBy(order).rowsBetween(before, end)
    local = chunks.withColumns({
        (f"_l_{out}" if long is not None else out): _FOLDS[fold](col).over(within)
        for out, (fold, col) in folds.items()})
    if long is None:
        return local

    earlier = Window.partitionBy("_g").orderBy("_chunk").rowsBetween(before, -1)
    totals = chunks.filter(F.col("_width").isNotNull()).groupBy("_g", "_chunk").agg(
        *[_FOLDS[fold](col).alias(f"_t_{out}") for out, (fold, col) in folds.items()])
    carried = totals.select("_g", "_chunk", *[
        _FOLDS[fold](f"_t_{out}").over(earlier).alias(f"_c_{out}")
        for out, (fold, _) in folds.items()
    ]).filter(reduce(lambda a, b: a | b, [F.col(f"_c_{out}").isNotNull() for out in folds]))
    return local.join(carried, ["_g", "_chunk"], "left").withColumns({
        out: _COMBINE[fold](F.col(f"_l_{out}"), F.col(f"_c_{out}"))
        for out, (fold, _) in folds.items()
    }).select(*chunks.columns, *folds)


def previous(
    chunks: DataFrame, order: str, columns: dict[str, str], long: list[DataFrame] | None = None
) -> DataFrame:
    """Adds `{out: column}`: the value in the row before this one in its key, else null.

    `chunks` comes from `cut` and keeps its columns.
    """
    within = Window.partitionBy("_g", "_chunk").orderBy(order)
    local = chunks.withColumns({out: F.lag(c).over(within) for out, c in columns.items()})
    if long is None:
        return local
    row = F.struct(*[F.col(c).alias(out) for out, c in columns.items()])
    last = chunks.filter(F.col("_width").isNotNull()).groupBy("_g", "_chunk").agg(
        F.max_by(row, F.col(order)).alias("_last"))
    carried = last.select("_g", "_chunk", F.lag("_last").over(
        Window.partitionBy("_g").orderBy("_chunk")).alias("_carried"))
    first = F.lag(order).over(within).isNull()
    return local.withColumn("_first", first).join(carried, ["_g", "_chunk"], "left").withColumns({
        out: F.when(F.col("_first"), F.col(f"_carried.{out}")).otherwise(F.col(out))
        for out in columns
    }).select(*chunks.columns, *columns)

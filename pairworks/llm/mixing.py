"""A schedule that mixes sources to target weights by a low-discrepancy sequence.

Every source's documents are shuffled, laid end to end and cut into blocks of equal numbers of
words. Van der Corput points are mapped through the cumulative shares of the sources: each point
is a slot of its source, and the slot's rank among that source's slots is the block it takes.
Any stretch of slots so has each source close to its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairworks.llm.common import WORD, fresh_name, materialise

MOST_REPEATS = 3
_BINS = 1024
_CHUNK = 4096
_BUCKET = 3  # hex digits of a document's place in the shuffle; documents are ordered within buckets


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: source, source_no, source_size, weight, target.

    Sources in the order of code points, null last, have the weights in turn and share the size
    of all. A target stops at MOST_REPEATS times its source's size; the rest is shared out again,
    which raises a common level per unit of weight until it fits. The sources that are full are
    those with the smallest ratio of limit to weight. Windows here go over sources, not documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * MOST_REPEATS
    fill = Window.orderBy(limit / F.col("weight"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level if all sources before this one were full, and this one and those after it not.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = sources.withColumn("level", level)
    open_ = F.col("level") * F.col("weight") <= limit
    in_order = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chosen = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(in_order)
    return levels.withColumn("target", F.least(limit.cast("double"), F.col("weight") * chosen)).select(
        "source", "source_no", "source_size", "weight", "target")


def _offsets(docs: DataFrame, order: list[str]) -> DataFrame:
    """With `offset`, the words before each document in its source's shuffled order.

    Sums per bucket come first, so that no task orders a whole source.
    """
    docs = docs.withColumn("bucket", F.substring("place", 1, _BUCKET))
    sums = docs.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        sums, ["source_no", "bucket"]).withColumn("offset", F.col("base") + F.col("inner")).drop("base", "inner", "bucket", "place")


def _point(n: Column) -> Column:
    """The van der Corput point of a number: its 52 binary digits reversed behind the point."""
    return F.conv(F.reverse(F.lpad(F.bin(n), 52, "0")), 2, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def schedule(sources: DataFrame, slots: int, block_words: int) -> DataFrame:
    """slot, source_no, block: the order in which blocks of sources are taken.

    `sources` are rows of `source_targets` with `quota`, the words to take. The points of slots 0,
    1, 2, ... are looked up in the cumulative shares, by bins of the unit interval. A source gets
    as many slots as it has blocks to give: later ones are dropped, and the few that a share
    lacks follow at the end.
    """
    spark = sources.sparkSession
    order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("quota").over(Window.partitionBy()).cast("double")
    shares = sources.filter("quota > 0").select(
        "source_no", "quota", (F.sum("quota").over(order) / total).alias("hi"),
        ((F.sum("quota").over(order) - F.col("quota")) / total).alias("lo"),
        F.ceil(F.col("quota") / block_words).alias("blocks"))
    bins = shares.withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("lo") * _BINS), F.least(F.floor(F.col("hi") * _BINS), F.lit(_BINS - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
    points = points.withColumn("bin", F.floor(F.col("point") * _BINS))
    hits = points.join(bins, "bin").filter("point >= lo AND point < hi").select("slot", "source_no").withColumn(
        "chunk", F.floor(F.col("slot") / _CHUNK))
    counts = hits.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = hits.withColumn("inner", F.row_number().over(within) - 1).join(bases, ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("base") + F.col("inner")).alias("block"))
    taken = ranked.join(shares.select("source_no", "blocks"), "source_no").filter("block < blocks").select(
        "slot", "source_no", "block")
    given = counts.groupBy("source_no").agg(F.sum("n").alias("given"))
    missing = shares.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter(
        "given < blocks").select("source_no", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("block"), "given")
    tail = missing.select((F.lit(slots) + F.col("block") - F.col("given")).alias("slot"), "source_no", "block")
    return taken.unionByName(tail)


def place_blocks(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = 512, seed: str = "mix",
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: a row for each document and block that holds some of it, with the block's slot.

    Columns: id, tag (digest of the text), source, size, source_no, source_size, target, offset,
    slot (null if the block is not taken), round, block, begin and end (words of the document). A document
    without words has one row without a block. A source's blocks go round its documents up to
    MOST_REPEATS times; the last block is cut where the quota, the rounded target, is reached.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("tag"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(sized, "mix-sizes")
    sources = materialise(source_targets(sized, weights).withColumn("quota", F.round("target").cast("long")), "mix-sources")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    s = sources.withColumnRenamed("source", "name")
    rows = sized.join(s, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("place", place)
    rows = _offsets(rows, ["place", id_col, "size", "tag"])
    total = sources.agg(F.sum("quota")).first()[0] or 0
    slots = schedule(sources, math.ceil(total / block_words), block_words)
    last = F.least(F.floor((F.col("quota") - 1) / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words))
    rounds = rows.withColumn("round", F.explode_outer(F.when(
        (F.col("size") > 0) & (F.col("quota") > F.col("offset")),
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - F.col("offset")) / F.col("source_size"))))))
    rounds = rounds.withColumn("from", F.col("round") * F.col("source_size") + F.col("offset"))
    pieces = rounds.withColumn("block", F.explode_outer(F.when(
        F.col("from").isNotNull(), F.sequence(F.floor(F.col("from") / block_words), last))))
    begin = F.greatest(F.col("block") * block_words - F.col("from"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("from"), F.col("size"), F.col("quota") - F.col("from"))
    pieces = pieces.withColumns({"begin": begin, "end": end})
    return pieces.join(slots, ["source_no", "block"], "left").select(
        id_col, "tag", "source", "size", "source_no", "source_size", "target", "offset", "slot", "round", "block", "begin", "end")


def _words_taken() -> Column:
    return F.when(F.col("slot").isNotNull(), F.col("end") - F.col("begin")).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = 512, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, tag, source, size, source_size, target, taken, the words the mix takes with repeats, and its place in
    the schedule: first_slot, null if nothing is taken, and n_slots, how many slots take a part of it.

    Null and empty texts have size 0 and take nothing; null sources are one source, the last;
    repeated rows count one by one; null ids are shuffled like others. Rows that agree in id,
    size and text may change places, which changes no result. Other columns are not read. An
    empty table gives an empty one.
    """
    blocks = place_blocks(docs, weights, block_words, seed, id_col, text_col, source_col)
    # Documents without words share an offset with the next one, so that they are grouped by size too.
    live = blocks.filter("size > 0").groupBy(id_col, "tag", "source", "size", "source_no", "source_size", "target", "offset").agg(
        F.sum(_words_taken()).alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    none = blocks.filter("size = 0").withColumns({
        "taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "n_slots": F.lit(0).cast("long")})
    columns = [id_col, "tag", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots"]
    return live.select(columns).unionByName(none.select(columns))


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = 512, seed: str = "mix",
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` in the mix, in the order of the schedule: each row as often as the mix takes it, a part of a document as
    the whole one, where the first slot that takes some of it in that round is.

    A source has one document at most that is taken in part, the one at which its quota ends. Rows that
    agree in id, source and text share what they are taken together, rounded up, and stand side by side. The
    result is partitioned by ranges of slots and sorted within them, so that any stretch of it has each source
    close to its share. Its columns are those of `docs`, whatever their names.
    """
    blocks = place_blocks(docs, weights, block_words, seed, id_col, text_col, source_col).filter("slot IS NOT NULL")
    names = {name: fresh_name(docs, name) for name in ("id", "source", "tag", "times", "slots", "copy", "slot")}
    rounds = blocks.groupBy(F.col(id_col).alias("id"), "source", "tag", "offset", "size", "round").agg(
        F.min("slot").alias("slot"), F.sum(_words_taken()).alias("taken"))
    # A document goes round MOST_REPEATS times and a part at most.
    rows = rounds.groupBy("id", "source", "tag", "offset", "size").agg(
        F.sum("taken").alias("taken"), F.sort_array(F.collect_list("slot")).alias("slots")).filter("taken > 0")
    times = materialise(rows.groupBy("id", "source", "tag").agg(
        F.ceil(F.sum("taken") / F.sum("size")).cast("int").alias("times"), F.min("slots").alias("slots")), "mix-times")
    times = times.select(*[F.col(name).alias(names[name]) for name in times.columns])
    joined = docs.join(times, F.col(id_col).eqNullSafe(F.col(names["id"])) & F.col(source_col).cast("string").eqNullSafe(F.col(names["source"]))
                       & (F.xxhash64(F.col(text_col)) == F.col(names["tag"])))
    slots = F.col(names["slots"])
    placed = joined.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["times"])))).withColumn(
        names["slot"], F.element_at(slots, F.least(F.col(names["copy"]), F.size(slots))))
    return placed.repartitionByRange(names["slot"]).sortWithinPartitions(names["slot"]).select(*[docs[c] for c in docs.columns])

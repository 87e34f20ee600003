"""A trie of conversation prefixes by ROLLUP over columns of turn ids.

A conversation lies in rows of WIDTH columns, a row per block of its turns, with one place more
than it has turns: the empty place ends it. Spark's ROLLUP over the columns of a block, within
the block's key, aggregates all prefixes at once, and grouping_id tells how long each is. A
block's key is the node at which the block before ends, so that conversations of any length
take one pass. A node is named by two 64-bit exclusive sums over its turns and their places,
which any number of tasks can work out side by side.

Sums over a subtree need no walk either. Each node belongs to the smallest of its members, and
each conversation brings what it owns, so that a second ROLLUP adds up the nodes below a prefix
as sums over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairworks.llm.common import materialise
from pairworks.plans.running import cut, long_keys, running

WIDTH = 8
STRETCH = 4096  # blocks of a conversation whose keys one task works out
ENDS = 4096  # ids that go into one piece of a list
NODE = ["depth", "x1", "x2"]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), id, in the order of the turns: one row per row with a conversation.

    `id` is the MD5 of role and text with the text's code points behind it; null roles and texts
    are empty. A null turn comes first; rows of one turn are put in the order of their ids. A long
    conversation is cut along its turns, so that no task orders all of it. Texts are not shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    id_ = F.concat(F.md5(F.encode(told, "UTF-8")), F.lpad(F.hex(F.length(text)), 8, "0"))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.unhex(id_).alias("id"))
    rows = materialise(rows.withColumn("one", F.lit(1).cast("long")), "trie-turns")
    place = F.struct("turn", "id")
    long = long_keys(rows, ["conv"], "turn")
    numbered = running(cut(rows.withColumn("place", place), ["conv"], "turn", long), "place", {"pos": ("sum", "one")}, long=long)
    return numbered.select("conv", "pos", "id")


def rebuilt(numbered: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) that begin as another: conv, n; and conv, pos, id.

    Conversation c takes the first h = crc32(c) mod `most` turns of conversation c - c mod `family`,
    or all if it has fewer, and then its own turns after its first h.
    """
    convs = numbered.groupBy("conv").agg(F.count("*").alias("own"))
    convs = convs.withColumns({"h": F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % most,
                               "base": F.col("conv") - F.col("conv") % family})
    bases = convs.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = materialise(convs.select(
        "conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("n")), "trie-convs")
    heads = numbered.filter((F.col("conv") % family == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), "pos", "id")
    first = convs.join(heads, "base").filter(F.col("pos") <= F.col("taken")).select("conv", "pos", "id")
    later = numbered.join(convs.select("conv", "h", "taken"), "conv").filter(F.col("pos") > F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id")
    return convs.select("conv", "n"), first.unionByName(later)


def _names(id_: Column, pos: Column) -> list[Column]:
    """What a turn at a place adds to the two sums that name a node; a missing turn adds nothing."""
    return [F.when(id_.isNotNull(), F.xxhash64(F.lit(salt), id_, pos.cast("long"))).otherwise(F.lit(0).cast("long")) for salt in (1, 2)]


def _chars(id_: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(id_, 17, 4)), 16, 10).cast("long"), F.lit(0).cast("long"))


def blocks(convs: DataFrame, turns_: DataFrame) -> DataFrame:
    """conv, n, block, t0 to t7, x1, x2, chars: rows of WIDTH turns, the last with an empty place.

    x1, x2 and chars are the name and the code points of all turns before the block.
    """
    ends = convs.select("conv", (F.col("n") + 1).alias("pos"), F.lit(None).cast("binary").alias("id"), "n")
    rows = turns_.withColumn("n", F.lit(None).cast("long")).unionByName(ends)
    x1, x2 = _names(F.col("id"), F.col("pos"))
    slot = (F.col("pos") - 1) % WIDTH
    wide = rows.groupBy("conv", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(
        *[F.max(F.when(slot == i, F.col("id"))).alias(f"t{i}") for i in range(WIDTH)],
        F.bit_xor(x1).alias("y1"), F.bit_xor(x2).alias("y2"), F.sum(_chars(F.col("id"))).alias("c"))
    wide = materialise(wide.withColumn("stretch", F.floor(F.col("block") / STRETCH)), "trie-wide")
    sums = {"x1": (F.bit_xor, "y1"), "x2": (F.bit_xor, "y2"), "chars": (F.sum, "c")}
    within = Window.partitionBy("conv", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = wide.groupBy("conv", "stretch").agg(*[fold(of).alias(name) for name, (fold, of) in sums.items()])
    # Conversations of one stretch bring nothing over.
    carried = stretches.join(wide.filter("stretch > 0").select(F.col("conv").alias("_conv")).distinct(), F.col("conv") == F.col("_conv"), "left_semi").select(
        "conv", "stretch", *[F.coalesce(fold(name).over(earlier), F.lit(0).cast("long")).alias(f"b_{name}") for name, (fold, _) in sums.items()])
    zero = F.lit(0).cast("long")
    local = wide.withColumns({name: F.coalesce(fold(of).over(within), zero) for name, (fold, of) in sums.items()})
    full = local.join(carried, ["conv", "stretch"], "left").withColumns({
        "x1": F.col("x1").bitwiseXOR(F.coalesce("b_x1", zero)), "x2": F.col("x2").bitwiseXOR(F.coalesce("b_x2", zero)),
        "chars": F.col("chars") + F.coalesce("b_chars", zero)})
    return materialise(full.select("conv", "block", *[f"t{i}" for i in range(WIDTH)], "x1", "x2", "chars"), "trie-blocks")


def _prefixes(rows: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes of the rows' blocks at once: depth, x1, x2, of the node, p1, p2, of its parent, chars (of its
    last turn), before (those ahead of it), real (false for the end of a conversation) and the aggregates."""
    columns = [f"t{i}" for i in range(WIDTH)]
    rolled = rows.sparkSession.sql(
        f"""SELECT block, x1, x2, {', '.join(columns)}, {WIDTH} - CAST(bit_count(grouping_id()) AS int) AS level,
                   max(chars) AS start, {aggregates}
            FROM {{rows}} GROUP BY block, x1, x2, ROLLUP ({', '.join(columns)})""", rows=rows)
    last = F.element_at(F.array(*[F.col(c) for c in columns]), F.col("level"))
    ahead = F.when(F.col("level") == 1, F.lit(b"")).otherwise(
        F.element_at(F.array(*[F.col(c) for c in columns]), F.greatest(F.col("level") - 1, F.lit(1))))
    rolled = rolled.filter("level > 0").withColumns({"last": last}).filter(F.col("last").isNotNull() | ahead.isNotNull())
    depth = F.col("block") * WIDTH + F.col("level")
    names = [_names(F.col(c), F.col("block") * WIDTH + i + 1) for i, c in enumerate(columns)]

    def named(side: int, upto: Column) -> Column:
        out = F.col(f"x{side + 1}")
        for i in range(WIDTH):
            out = out.bitwiseXOR(F.when(F.lit(i) < upto, names[i][side]).otherwise(F.lit(0).cast("long")))
        return out

    before = F.col("start")
    for i, c in enumerate(columns):
        before = before + F.when(F.lit(i) < F.col("level") - 1, _chars(F.col(c))).otherwise(F.lit(0))
    kept = [c for c in rolled.columns if c not in {*columns, "block", "level", "x1", "x2", "start", "last"}]
    return rolled.select(
        depth.cast("long").alias("depth"), named(0, F.col("level")).alias("x1"), named(1, F.col("level")).alias("x2"),
        named(0, F.col("level") - 1).alias("p1"), named(1, F.col("level") - 1).alias("p2"), _chars(F.col("last")).alias("chars"),
        before.alias("before"), F.col("last").isNotNull().alias("real"), *kept)


def list_digests(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and ends_sha256, the SHA-256 of the values of each key in order, joined by commas.

    Values are cut into pieces of ENDS along their order first, whatever their key, so that the
    task that digests a hot key reads its pieces and nothing else, one after the other.
    """
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values, firsts, joined, last = [], batch.column(len(keys)).to_pylist(), [], [], None
            for key, v in zip(zip(*[c.to_pylist() for c in batch.columns[:len(keys)]], strict=True), values, strict=True):
                if key != last or len(joined[-1]) >= ENDS:
                    names.append(key)
                    firsts.append(v)
                    joined.append([])
                joined[-1].append(str(v))
                last = key
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([n[i] for n in names], batch.schema.field(i).type) for i in range(len(keys))],
                 pa.array(firsts, pa.int64()), pa.array([",".join(j) for j in joined], pa.string())], [*keys, "first", "joined"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, types = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, types, strict=True)],
                                               pa.array([state.hexdigest()], pa.string())], [*keys, "ends_sha256"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            for *this, joined in zip(*[c.to_pylist() for c in (*batch.columns[:len(keys)], batch.column(len(keys) + 1))], strict=True):
                if this != key:
                    if key is not None:
                        yield told()
                    key, state = this, hashlib.sha256(joined.encode())
                else:
                    state.update(b"," + joined.encode())
        if key is not None:
            yield told()

    ordered = rows.select(*keys, F.col(value).alias("value")).repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")
    cut_ = materialise(ordered.mapInArrow(pieces, f"{fields}, first long, joined string"), "trie-ends")
    by_key = cut_.repartition(*keys).sortWithinPartitions(*keys, "first")
    return by_key.mapInArrow(digests, f"{fields}, ends_sha256 string")


def trie(convs: DataFrame, turns_: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and x1, x2, the node's name.

    `convs` are (conv, n), each once, `turns_` (conv, pos from 1 without gaps, id) as `turns` makes
    them. The root, of depth 0, is there if there is any conversation.
    """
    rows = blocks(convs, turns_)
    found = materialise(_prefixes(rows, "count(*) AS n_convs, min(conv) AS conv_id"), "trie-prefixes")
    zero = F.lit(0).cast("long")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count_if("real").alias("n_children"))
    children = children.filter("n_children > 0")
    nodes = found.filter("real").drop("real").join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialise(nodes, "trie-nodes")
    # What each conversation brings: its code points, and the nodes whose smallest member it is.
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("chars").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaf"), F.min("depth").alias("owns_from"),
        F.min_by("before", "depth").alias("owns_before"))
    totals = rows.groupBy("conv").agg(F.max(F.col("chars") + sum((_chars(F.col(f"t{i}")) for i in range(WIDTH)), F.lit(0))).alias("total"))
    brought = materialise(totals.join(owned, "conv", "left").select(
        "conv", "total", *[F.coalesce(c, zero).alias(c) for c in ("own", "leaf", "owns_from", "owns_before")]), "trie-brought")
    sums = "sum(total) AS total, sum(own) AS own, sum(leaf) AS n_leaves"
    added = _prefixes(rows.join(brought.select("conv", "total", "own", "leaf"), "conv"), sums).filter("real")
    nodes = nodes.join(added.select(*NODE, "total", "own", "n_leaves"), NODE)
    first = brought.select(F.col("conv").alias("conv_id"), "owns_from", "owns_before")
    nodes = nodes.join(first, "conv_id")
    # Turns of all members from here on, less the nodes below; the smallest member owns nodes above too.
    saved = (F.col("total") - F.col("n_convs") * F.col("before")) - (F.col("own") - (F.col("before") - F.col("owns_before")))
    nodes = materialise(nodes.withColumn("saved_tokens", saved).select(
        "conv_id", *NODE, "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens", "owns_from"), "trie-sums")
    # Only where a conversation's own nodes begin does the parent belong to another.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    begins = nodes.filter("depth = owns_from")
    deeper = begins.filter("depth > 1").join(above, ["depth", "p1", "p2"])
    root = brought.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
                       (F.sum("total") - F.sum("own")).alias("saved_tokens")).filter("n_convs > 0")
    root = root.withColumns({"depth": zero, "x1": zero, "x2": zero, "parent_conv_id": F.lit(None).cast("long")})
    top = begins.filter("depth = 1").join(
        F.broadcast(root.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))), "depth")
    inner = nodes.filter("depth > owns_from").withColumn("parent_conv_id", F.col("conv_id"))
    whole = inner.unionByName(deeper).unionByName(top).drop("p1", "p2", "owns_from")
    root = root.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn(
        "n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
    whole = whole.unionByName(root)
    x1, x2, n = F.col("x1"), F.col("x2"), F.col("block") * WIDTH
    for i in range(WIDTH):
        one, two = _names(F.col(f"t{i}"), F.col("block") * WIDTH + i + 1)
        x1, x2, n = x1.bitwiseXOR(one), x2.bitwiseXOR(two), n + F.col(f"t{i}").isNotNull().cast("long")
    # Each conversation has one block with an empty place.
    ends = rows.filter(F.col(f"t{WIDTH - 1}").isNull()).select(n.alias("depth"), x1.alias("x1"), x2.alias("x2"), "conv")
    digests = list_digests(ends, NODE, "conv")
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(digests, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "x1", "x2")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of `rebuilt` conversations, without the nodes' names.

    Rows without a conversation take no part, other columns than conv_id, turn, role and text are
    not read, repeated rows are turns that repeat, and an empty table gives an empty one.
    """
    return trie(*rebuilt(materialise(turns(conversations), "trie-numbered"))).drop("x1", "x2")

"""Near duplicates by a chosen-path similarity join.

Documents with the same set of shingles become one class. In each of several independent trees
the root and every large node choose minwise tokens, and each class goes on to the child of the
token it has there; alike classes mostly go together. Small nodes are compared exhaustively by
their sketches, and what is alike is confirmed on the full sets.

Groups of many alike classes never shrink on the way down, and comparing all their pairs would
be of no use, as one connected group is all that is asked for. Links are therefore found in two
rounds. The first ties each class of a node to the smallest class of its block and node that it
is like; confirmed links make groups. The second compares pairs of different groups only: nodes
that hold one group are done, others branch on until they are small, and every pair in them that
belongs to different groups and may be alike is confirmed. A node of up to WHOLE classes goes that
way inside one task, larger ones level by level. Classes whose nodes are still large at
the last level are alike throughout: classes with a common node are put together once for all
trees and compared block by block, on the full sets and in the task, so that only links come out
and their number grows with the classes and not with the pairs. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.llm.common import Remembered, fresh_name, map_batches, materialise
from pairworks.llm.components import components

WORDS = 3  # in a shingle
TOKENS = 64  # minwise tokens of a sketch
TREES = 10
LEVELS = 3
DEEPEST = 10  # where branching ends for nodes that are still large
SMALL = 64  # classes in a node that is compared exhaustively
WHOLE = 8192  # classes in a node, 280 bytes each, that branches on within a task
BLOCK = 256  # classes of a dense group that are compared with as many others at a time
LIKE = 85  # per cent of the union that two sets share
# Sketches of sets at the threshold agree in at least this many of 64 tokens, but for odds below 1e-6.
SKETCH = 39
_EXTRA = 18  # per cent of nodes that choose two tokens and not one, near 100 / LIKE on average
_EXTRA_DEEP = 30  # the same below LEVELS
_SEED = 7

_MULTIPLY = np.random.default_rng(_SEED).integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(_SEED + 1).integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_words = Remembered(lambda words: [xxhash.xxh3_64_intdigest(word) for word in words])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, so that sums of products are spread over all bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z, a short text is one shingle."""
    hashes = _words.look_up([text.encode("utf-8", "surrogatepass").lower().split() for text in texts])
    factors = _mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    out = []
    for found in hashes:
        h = np.array(found, np.uint64)
        n = min(len(h), words)
        if not n:
            out.append(h)
            continue
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total += _mixed(h[k:len(h) - n + 1 + k] * factors[k])
        out.append(np.unique(_mixed(total)))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set: per hash function the upper half of the smallest value."""
    out = np.full(TOKENS, ~np.uint64(0))
    for start in range(0, len(shingles), 4096):
        part = shingles[start:start + 4096]
        for k in range(TOKENS):
            out[k] = min(out[k], (part * _MULTIPLY[k] + _ADD[k]).min())
    return (out >> np.uint64(32)).astype("<u4")


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tag (digest of the text), n (shingles), set_id (digest of the set, null if empty), sig (sketch)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([text or "" for text in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["id", "tag", "n", "set_id", "sig"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col)).alias("tag")), run,
                       f"id {id_type}, tag long, n long, set_id long, sig binary")


def _choices(node: Column, extra: int) -> Column:
    """The numbers of the tokens that a node chooses: one, or two for `extra` per cent of all nodes."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
    return F.when(F.pmod(F.xxhash64(node, F.lit(3)), F.lit(100)) < extra, F.array(first, second)).otherwise(F.array(first))


def _child(node: Column, choice: Column) -> Column:
    return F.xxhash64(node, choice, F.substring(F.col("sig"), choice * 4 + 1, F.lit(4)))


def _branch(rows: DataFrame, extra: int = _EXTRA) -> DataFrame:
    """The rows of nodes (with node and sig) in the children that the nodes choose."""
    chosen = rows.withColumn("choice", F.explode(_choices(F.col("node"), extra)))
    return chosen.withColumn("node", _child(F.col("node"), F.col("choice"))).drop("choice")


def _alike(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs may be alike: by their sizes, exactly, and by their sketches."""
    less, more = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    able = less * 100 >= more * LIKE
    out = np.zeros(len(left), bool)
    at = np.flatnonzero(able)
    for start in range(0, len(at), 16384):
        some = at[start:start + 16384]
        out[some] = (sig[left[some]] == sig[right[some]]).sum(axis=1) >= SKETCH
    return out


def _unpacked(cell: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array([x["set_id"] for x in cell], np.int64), np.array([x["n"] for x in cell], np.int64),
            np.frombuffer(b"".join(x["sig"] for x in cell), "<u4").reshape(len(cell), TOKENS))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["a", "b"])


def _first_alike(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each class of a group the smallest class of the group that it may be like."""
    lefts, rights = [], []
    for cell in batch.column(0).to_pylist():
        ids, n, sig = _unpacked(cell)
        left, right = np.triu_indices(len(ids), 1)
        hit = _alike(sig, n, left, right)
        left, right = left[hit], right[hit]
        # Members come sorted, so that the first partner of `right` is its smallest.
        order = np.lexsort((left, right))
        left, right = left[order], right[order]
        lead = np.r_[True, right[1:] != right[:-1]] if len(right) else np.zeros(0, bool)
        lefts.append(ids[left[lead]])
        rights.append(ids[right[lead]])
    return _pairs(np.concatenate(lefts) if lefts else np.zeros(0, np.int64), np.concatenate(rights) if rights else np.zeros(0, np.int64))


def _xxhash64(values: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of longs, or of integers or four bytes if they are 32 bits wide; `seed` is the hash so far."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    h = np.asarray(seed, np.uint64) + p5 + np.uint64(values.itemsize)
    if values.itemsize == 8:
        h = turned(h ^ turned(values.view(np.uint64) * p2, 31) * p1, 27) * p1 + p4
    else:
        h = turned(h ^ values.astype(np.uint64) * p1, 23) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _branched(node: np.ndarray, sig: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """What `_branch` does, in a task and with the same nodes: which row goes on, and its node below."""
    start = _xxhash64(node)
    first, second, third = (_xxhash64(np.full(len(node), k, np.uint32), start).view(np.int64) for k in (1, 2, 3))
    first = first % TOKENS
    both = np.flatnonzero(third % 100 < extra)
    at, choice = np.r_[np.arange(len(node)), both], np.r_[first, ((first + 1 + second % (TOKENS - 1)) % TOKENS)[both]]
    return at, _xxhash64(sig[at, choice], _xxhash64(choice.astype(np.uint32), start[at]))


def _alike_throughout(ids: np.ndarray, sig: np.ndarray) -> bool:
    """What `_alike_nodes` asks of a node, in a task."""
    heads = sig[[ids.argmin(), ids.argmax(), _xxhash64(ids).view(np.int64).argmin()]]
    return np.mean([(sig == head).sum(axis=1) >= SKETCH for head in heads]) >= 0.25


def _across_groups(node: int, level: int, cell: list[dict], small: int) -> tuple[list, list]:
    """Of a node with all its members: (a, b) of members of different groups that may be alike, out
    of small nodes in and below it, and (node, set_id) of those that go to the comparison by blocks."""
    ids, n, sig = _unpacked(cell)
    labels = np.array([x["label"] for x in cell], np.int64)
    pairs, dense = [], []
    at, nodes = np.arange(len(ids)), np.full(len(ids), node, np.int64).view(np.uint64)
    while True:
        order = np.argsort(nodes, kind="stable")
        at, nodes = at[order], nodes[order]
        starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        differ = np.minimum.reduceat(labels[at], starts) != np.maximum.reduceat(labels[at], starts)
        further = np.zeros(len(at), bool)
        for start, end in zip(starts[differ], np.r_[starts[1:], len(at)][differ], strict=True):
            some = at[start:end]
            if len(some) <= small:
                left, right = (some[x] for x in np.triu_indices(len(some), 1))
                other = labels[left] != labels[right]
                left, right = left[other], right[other]
                hit = _alike(sig, n, left, right)
                pairs.append(np.column_stack([ids[left[hit]], ids[right[hit]]]))
            elif level == DEEPEST or level == LEVELS and _alike_throughout(ids[some], sig[some]):
                dense.append(np.column_stack([nodes[start:end].view(np.int64), ids[some]]))
            else:
                further[start:end] = True
        if not further.any():
            break
        at, nodes = at[further], nodes[further]
        rows, nodes = _branched(nodes, sig[at], _EXTRA if level < LEVELS else _EXTRA_DEEP)
        at, level = at[rows], level + 1
    return pairs, dense


def _whole_nodes(batch: pa.RecordBatch, small: int) -> pa.RecordBatch:
    """`_across_groups` of each node: pairs once (a, b, false) and members of dense nodes (node, set_id, true)."""
    pairs, dense = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for node, level, cell in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        found = _across_groups(node, level, cell, small)
        pairs += found[0]
        dense += found[1]
    once = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
    both = np.concatenate([once, *dense])
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(once))], ["a", "b", "dense"])


def _block_links(ours: list[dict], theirs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks, confirmed on the full sets; pairs that links found so far connect are left out.

    Pairs of two members of `theirs` and of two of `ours` are not compared here. A member of ours
    that is not in the main group meets the others from either side, and counts on one.
    """
    ids, n, sig = _unpacked(ours + theirs)
    k, m = len(ours), len(ours) + len(theirs)
    group = np.unique([x["label"] for x in ours + theirs], return_inverse=True)[1]
    minor = np.array([x["minor"] for x in ours], bool)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(k), np.arange(k, m), indexing="ij"))
    once = ~minor[left] | (ids[left] < ids[right])
    left, right = left[once], right[once]
    hit = _alike(sig, n, left, right)
    left, right = left[hit], right[hit]
    sets = [np.frombuffer(x["shingles"], np.uint64) for x in ours + theirs]
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([0, *map(len, sets)])
    mark = np.zeros(token.max(initial=0) + 1, bool)
    # Members with most candidates first: they connect the most, and what is connected is done.
    weight = np.bincount(left, minlength=m)
    links = []
    starts = np.searchsorted(left, np.arange(k + 1))
    for i in np.argsort(-weight[:k], kind="stable"):
        others = right[starts[i]:starts[i + 1]]
        others = others[group[others] != group[i]]
        if not len(others):
            continue
        mark[token[ends[i]:ends[i + 1]]] = True
        at = np.concatenate([token[ends[j]:ends[j + 1]] for j in others])
        sizes = n[others]
        common = np.add.reduceat(mark[at], np.cumsum(sizes) - sizes, dtype=np.int64)
        mark[token[ends[i]:ends[i + 1]]] = False
        for j in others[100 * common >= LIKE * (n[i] + sizes - common)]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                links.append((ids[i], ids[j]))
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _dense_links(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [_block_links(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if a and b]
    return _pairs(*(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)))


def _first_round(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate links that tie the classes of every node to a smallest one, by way of blocks of SMALL.

    A large node's classes are dealt by hash into blocks, and each block also gets the node's
    smallest class, so that alike classes of different blocks meet in it.
    """
    blocks = F.ceil(F.col("size") / SMALL).cast("int")
    own = F.array(F.pmod(F.xxhash64("set_id"), blocks).cast("int"))
    dealt = F.explode(F.when(F.col("set_id") == F.col("least"), F.sequence(F.lit(0), blocks - 1)).otherwise(own)).alias("block")
    groups = nodes.join(classes, "set_id").select("node", dealt, F.struct("set_id", "n", "sig").alias("m")).groupBy("node", "block").agg(
        F.array_sort(F.collect_list("m")).alias("members"))
    return map_batches(groups.filter(F.size("members") > 1).select("members"), _first_alike, "a long, b long", rows=200).distinct()


def _alike_nodes(large: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes in which at least a quarter of the sketches pass for alike to three of the node's members."""
    ends = (F.min("set_id"), F.max("set_id"), F.min_by("set_id", F.xxhash64("set_id")))
    heads = large.groupBy("node").agg(F.array(*ends).alias("heads")).select("node", F.explode("heads").alias("head"))
    heads = heads.join(rows.select(F.col("set_id").alias("head"), F.col("sig").alias("head_sig")), "head").groupBy("node").agg(
        F.array_join(F.transform(F.collect_list("head_sig"), F.hex), "").alias("head_sigs"))
    paired = large.join(heads, "node").join(rows.select("set_id", "sig"), "set_id").select("node", "sig", F.unhex("head_sigs").alias("heads"))

    def passing(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = len(batch)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(count, 1, TOKENS)
        of_heads = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(count, -1, TOKENS)
        share = ((sig == of_heads).sum(axis=2) >= SKETCH).mean(axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.float64())], ["node", "share"])

    return map_batches(paired, passing, "node long, share double").groupBy("node").agg(F.avg("share").alias("share")).filter(
        "share >= 0.25").select("node")


def _second_round(nodes: DataFrame, rows: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes with two groups or more: candidate links, but those of `first`, between the groups of
    small ones, and (node, set_id) of those that are large at LEVELS and alike throughout, or still
    large at DEEPEST. `rows` are classes with their label. Nodes of up to WHOLE classes are done in
    one go at the end."""
    whole = nodes.filter(F.col("size") <= WHOLE).select("node", "set_id", F.lit(1).alias("level"))
    large = nodes.filter(F.col("size") > WHOLE).select("node", "set_id")
    dense = large.limit(0)
    for level in range(1, DEEPEST):
        if large.isEmpty():
            break
        if level == LEVELS:
            of_one = materialise(_alike_nodes(large, rows), "path-alike")
            dense = large.join(of_one, "node", "left_semi")
            large = large.join(of_one, "node", "left_anti")
        # A row's two choices are different nodes, so that no row comes twice.
        named = materialise(_branch(large.join(rows.select("set_id", "sig", "label"), "set_id"), _EXTRA if level < LEVELS else _EXTRA_DEEP).select(
            "node", "set_id", "label"), "path-labels")
        stats = named.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("one"), F.max("label").alias("other"))
        stats = materialise(stats.filter("one <> other").select("node", "size"), "path-sizes")
        sized = named.select("node", "set_id").join(stats, "node")
        whole = whole.unionByName(sized.filter(F.col("size") <= WHOLE).select("node", "set_id", F.lit(level + 1).alias("level")))
        large = sized.filter(F.col("size") > WHOLE).select("node", "set_id")
    groups = whole.join(rows, "set_id").groupBy("node", "level").agg(F.collect_list(F.struct("set_id", "n", "sig", "label")).alias("members"))
    labels = F.col("members.label")
    groups = groups.filter(F.array_min(labels) != F.array_max(labels))
    found = materialise(map_batches(groups, partial(_whole_nodes, small=SMALL), "a long, b long, dense boolean", rows=200), "path-found")
    pairs = found.filter("NOT dense").select("a", "b", F.lit(False).alias("old")).unionByName(first.select("a", "b", F.lit(True).alias("old")))
    new = pairs.groupBy("a", "b").agg(F.max("old").alias("old")).filter("NOT old").select("a", "b")
    return new, dense.unionByName(large).unionByName(found.filter("dense").select(F.col("a").alias("node"), F.col("b").alias("set_id")))


def _within_dense(dense: DataFrame, rows: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between classes of dense nodes that are in different groups.

    Classes with a common node are one body. Its largest group needs no comparison within itself:
    each block of the body meets each block of the others.
    """
    least = dense.groupBy("node").agg(F.min("set_id").alias("a"))
    bodies = components(dense.join(least, "node").select("a", F.col("set_id").alias("b")).distinct()).select(
        F.col("node").alias("set_id"), F.col("label").alias("body"))
    full = bodies.join(rows, "set_id").join(_sets(bodies.select("set_id"), docs, classes, id_col, text_col), "set_id")
    full = materialise(full, "dense")
    counts = full.groupBy("body", "label").agg(F.count("*").alias("k"))
    main = counts.groupBy("body").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("total")).select(
        "body", F.col("top.label").alias("main"), F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("total") - F.col("top.k")) / BLOCK).cast("int").alias("other_blocks"))
    full = full.join(materialise(main.filter("other_blocks > 0"), "bodies"), "body").withColumn("minor", F.col("label") != F.col("main"))
    member = F.struct("set_id", "n", "sig", "label", "minor", "shingles")
    hashed = F.xxhash64("set_id")
    ours = full.select("body", F.pmod(hashed, F.col("blocks")).cast("int").alias("i"),
                       F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("j"), member.alias("our"),
                       F.lit(None).cast(full.select(member.alias("m")).schema["m"].dataType).alias("their"))
    theirs = full.filter("minor").select(
        "body", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
        F.pmod(hashed, F.col("other_blocks")).cast("int").alias("j"),
        F.lit(None).cast(full.select(member.alias("m")).schema["m"].dataType).alias("our"), member.alias("their"))
    groups = ours.unionByName(theirs).groupBy("body", "i", "j").agg(
        F.collect_list("our").alias("ours"), F.collect_list("their").alias("theirs"))
    return materialise(map_batches(groups.select("ours", "theirs"), _dense_links, "a long, b long", rows=4), "dense-links")


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set_id, shingles) of the wanted classes, made again from the text of one document of each."""
    ids = wanted.distinct().join(classes.select("set_id", "id"), "set_id").select(F.col("id").alias("wanted_id"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s for s in shingle_sets([text or "" for text in batch.column(0).to_pylist()]) if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.int64()),
                                           pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "shingles"])

    # Documents that share an id with a wanted one but not its set find no partner later on.
    return materialise(map_batches(texts.select("text"), run, "set_id long, shingles binary").dropDuplicates(["set_id"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets share at least LIKE per cent of their union."""
    full = _sets(pairs.select(F.explode(F.array("a", "b")).alias("set_id")), docs, classes, id_col, text_col)

    def like(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= LIKE * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(full.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    two = one.join(full.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a")
    return materialise(map_batches(two.select("a", "b", "x", "y"), like, "a long, b long", rows=256), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, its own included), kept, tag.

    A link joins two documents whose sets share at least LIKE per cent of their union. Null texts
    and texts without words have no shingles and no links. `kept` is true for the rows whose id
    is that of their component. Rows that repeat an id and a text are one component and all kept
    or none; rows that repeat an id with other texts are linked only if alike. A null id counts as
    larger than any other; a component without an id has none and is kept. Other columns are not
    read, an empty table gives an empty one. `tag` is the xxhash64 of the text.
    """
    return _grouped(docs, id_col, text_col).drop("group")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_duplicates with `group`, the label of the component; null without shingles."""
    found = materialise(sketches(docs, id_col, text_col), "sketches")
    classes = materialise(found.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    sketched = classes.select("set_id", "n", "sig")
    roots = F.explode(F.array(*[F.xxhash64(F.lit(_SEED), F.lit(tree)) for tree in range(TREES)]))
    nodes = _branch(classes.select("set_id", "sig", roots.alias("node"))).select("node", "set_id")
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("set_id").alias("least")).filter("size > 1")
    nodes = materialise(nodes.join(sizes, "node"), "nodes")
    first = materialise(_first_round(nodes, sketched), "candidates")
    links = _confirmed(first, docs, classes, id_col, text_col)
    labels = components(links)
    rows = sketched.join(labels, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "n", "sig", F.coalesce("label", "set_id").alias("label"))
    rows = materialise(rows, "labelled")
    second, dense = _second_round(nodes, rows, first)
    second = materialise(second, "candidates")
    more = links
    if not second.isEmpty():
        more = more.unionByName(_confirmed(second, docs, classes, id_col, text_col))
    dense = materialise(dense, "dense-nodes")
    if not dense.isEmpty():
        more = more.unionByName(_within_dense(dense, rows, docs, classes, id_col, text_col))
    labels = components(more)
    grouped = classes.select("set_id", "id").join(labels, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "id", F.coalesce("label", "set_id").alias("label"))
    least = grouped.groupBy("label").agg(F.min("id").alias("component_id"))
    named = materialise(grouped.join(least, "label").select("set_id", "component_id", "label"), "set-components")
    with_sets = found.filter("set_id IS NOT NULL").select("id", "tag", "n", "set_id").join(named, "set_id").select(
        "id", "tag", "n", "component_id", "label")
    alone = found.filter("set_id IS NULL").select("id", "tag", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return with_sets.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "tag",
        F.col("label").alias("group"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` per component: the one with the smallest id, a null id being larger than any
    other, and of several with that id the one whose text has the smallest tag. A text without
    shingles is a component of its own with the rows that repeat its id and text. Documents are
    joined to the decisions by id and digest of the text; columns of any name come through."""
    # All kept rows of a component have the same id, or none has one.
    alone = F.when(F.col("group").isNull(), F.col("tag"))
    kept_id, kept_tag, own_tag = (fresh_name(docs, name) for name in ("kept_id", "kept_tag", "own_tag"))
    found = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    kept = found.filter("kept").groupBy("group", alone.alias("alone"), F.col("doc_id").alias(kept_id))
    decided = materialise(kept.agg(F.min("tag").alias(kept_tag), F.count("*").alias("rows")), "kept")
    tag = F.xxhash64(F.col(text_col))
    stay = docs.join(decided.select(kept_id, kept_tag), F.col(id_col).eqNullSafe(F.col(kept_id)) & (tag == F.col(kept_tag)), "left_semi")
    if decided.filter("rows > 1").isEmpty():
        return stay
    return stay.withColumn(own_tag, tag).dropDuplicates([id_col, own_tag]).drop(own_tag)

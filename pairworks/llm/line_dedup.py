"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

An index holds, for documents that come and go in steps,
- `references`: a row per document and key of a line, appended by each step;
- `counts`: the exact table, a row per key with its number of references and the smallest and
  the largest document that holds it;
- `filters`: a row per shard of the keys with a cuckoo filter of the keys that `counts` holds.

A key that the filters do not know is new and goes into the counts without being looked up; only
keys that they may know meet the exact table. Every live key has one fingerprint, and the exact
table decides what is live, so that a fingerprint can be taken out again with the last document
that holds its key. An index is a value: each step returns a new one and leaves the old.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairworks.llm.common import map_batches, materialise, new_path

LEAST_CHARS = 10
SLOTS = 4
BUCKETS = 1 << 14
SHARD_KEYS = 45_000  # keys of the first step per shard: a load of about 0.7
KICKS = 200
_SALTS = 16
# What is stripped from both ends of a line.
_SPACE = b" \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def _line_keys(text: str | None, least: int) -> list[bytes | None]:
    """The digest of each line's key; None for a key too short to count."""
    out = []
    for line in (text or "").encode("utf-8").lower().split(b"\n"):  # of bytes only A-Z are lowered
        key = line.strip(_SPACE)
        # A code point has at most four bytes.
        long = len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8")) >= least)
        out.append(hashlib.md5(key, usedforsecurity=False).digest() if long else None)
    return out


def line_references(docs: DataFrame, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, tag, h1, h2: a row per row of `docs` and different key of its lines.

    `tag` is a digest of the text: with it rows that share an id, or have none, are told apart.
    """
    schema = f"doc {docs.schema[id_col].dataType.simpleString()}, tag long, h1 long, h2 long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [{k for k in _line_keys(text, least) if k is not None} for text in batch.column(2).to_pylist()]
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        halves = np.frombuffer(b"".join(b"".join(k) for k in keys), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
            ["doc", "tag", *_KEY])

    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return map_batches(docs.select(F.col(id_col), tag, F.col(text_col)), run, schema, rows=256)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints; a part more is put behind when the last one is full."""

    def __init__(self, data: bytes | None = None, buckets: int = BUCKETS):
        self.mask = buckets - 1
        stored = np.zeros(buckets * SLOTS, np.uint16) if data is None else np.frombuffer(data, np.uint16).copy()
        self.parts = list(stored.reshape(-1, buckets, SLOTS))
        self._random = np.random.default_rng(1)

    def data(self) -> bytes:
        return b"".join(part.tobytes() for part in self.parts)

    def _place(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        print_ = (h2 & 0xFFFF).astype(np.uint16)
        return np.where(print_ == 0, np.uint16(1), print_), h1 & self.mask

    def _other(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint, from either."""
        return bucket ^ ((print_.astype(np.int64) * 0x5BD1E995 >> 7) & self.mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        print_, bucket = self._place(h1, h2)
        other = self._other(print_, bucket)
        found = np.zeros(len(h1), bool)
        for part in self.parts:
            found |= (part[bucket] == print_[:, None]).any(1) | (part[other] == print_[:, None]).any(1)
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """A fingerprint more per key; keys must be different and not be in yet."""
        print_, bucket = self._place(h1, h2)
        while len(print_):
            print_, bucket = self._fill(self.parts[-1], print_, bucket)
            if len(print_):
                self.parts.append(np.zeros((self.mask + 1, SLOTS), np.uint16))

    def _fill(self, part: np.ndarray, print_: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places what it can, one a bucket and round; returns what has no place after KICKS rounds
        in which nearly all were evictions."""
        kicks = 0
        while len(print_) and kicks < KICKS:
            _, lead = np.unique(bucket, return_index=True)
            at, mine = bucket[lead], print_[lead]
            free = part[at] == 0
            room = free.any(1)
            slot = np.where(room, free.argmax(1), self._random.integers(0, SLOTS, len(at)))
            out = part[at, slot]
            part[at, slot] = mine
            rest = np.ones(len(print_), bool)
            rest[lead] = False
            # Who was put out goes to the other bucket.
            out, at = out[~room], at[~room]
            print_ = np.r_[print_[rest], out]
            bucket = np.r_[bucket[rest], self._other(out, at)]
            kicks += 100 * int(room.sum()) < len(lead)
        return print_, bucket

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Takes out one fingerprint per key; every key must have been added."""
        print_, bucket = self._place(h1, h2)
        todo = np.arange(len(print_))
        for part in self.parts:
            for side in (bucket, self._other(print_, bucket)):
                left = todo
                while len(left):
                    _, lead = np.unique(side[left], return_index=True)
                    some = left[lead]
                    match = part[side[some]] == print_[some][:, None]
                    hit = match.any(1)
                    part[side[some][hit], match.argmax(1)[hit]] = 0
                    todo = np.setdiff1d(todo, some[hit], assume_unique=True)
                    left = np.delete(left, lead)
        if len(todo):
            raise ValueError(f"{len(todo)} keys are not in the filter")


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 34), F.lit(shards)).cast("int"))


def _through_filters(index: LineIndex, keys: DataFrame, todo: str) -> DataFrame:
    """`probe`: those of `keys` that the filters may know. `add`, `remove`: the filters afterwards.

    A shard's filter comes before its keys, which stream past it: a task holds one filter and one
    batch of keys. Keys are different from each other, so that shards are of a size.
    """
    rows = _sharded(keys.select(*_KEY), index.shards).select("shard", *_KEY, F.lit(None).cast("binary").alias("data"))
    if index.filters:
        rows = rows.unionByName(index.stored_filters().select("shard", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "data"))
    buckets = index.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        told = lambda: pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([now.data()], pa.binary())], ["shard", "data"])
        for batch in batches:
            shard_of = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(shard_of)) + 1, len(shard_of)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                some = batch.slice(start, end - start)
                if shard is None or shard_of[start] != shard:
                    if shard is not None and todo != "probe":
                        yield told()
                    shard, now = int(shard_of[start]), None
                if now is None:
                    data = some.column(3)[0].as_py()
                    now = Cuckoo(data, buckets)
                    some = some if data is None else some.slice(1)
                h1, h2 = (some.column(i).to_numpy() for i in (1, 2))
                if not len(h1):
                    continue
                if todo == "probe":
                    yield some.select(_KEY).filter(pa.array(now.contains(h1, h2)))
                else:
                    getattr(now, todo)(h1, h2)
        if shard is not None and todo != "probe":
            yield told()

    by_shard = rows.repartition("shard").sortWithinPartitions("shard", F.col("h1").isNotNull())
    return by_shard.mapInArrow(run, "h1 long, h2 long" if todo == "probe" else "shard int, data binary")


def _counted(references: DataFrame) -> DataFrame:
    """A row per key; partial sums before the shuffle keep a hot key small."""
    return references.groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("no_id"))


def _merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*_KEY).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("no_id").alias("no_id"))


@dataclass(frozen=True)
class LineIndex:
    """Where the tables of an index are. `deletions` has the ids taken out, and in which step."""

    spark: SparkSession
    id_type: str
    shards: int = 0
    step: int = 0
    references: tuple[str, ...] = ()
    deletions: tuple[str, ...] = ()
    counts: str | None = None
    filters: str | None = None
    least: int = LEAST_CHARS
    buckets: int = BUCKETS

    def _write(self, rows: DataFrame, label: str) -> str:
        path = new_path(self.spark, label)
        rows.write.parquet(path)
        return path

    def _read(self, columns: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(columns).parquet(*paths)

    def stored_references(self, *paths: str) -> DataFrame:
        return self._read(f"doc {self.id_type}, tag long, h1 long, h2 long, step int", *paths)

    def stored_counts(self) -> DataFrame:
        return self._read(f"h1 long, h2 long, n long, first {self.id_type}, last {self.id_type}, no_id boolean", self.counts)

    def stored_filters(self) -> DataFrame:
        return self._read("shard int, data binary", self.filters)

    def live_references(self) -> DataFrame:
        """doc, tag, h1, h2 of the documents that have not been deleted since they came."""
        rows = self.stored_references(*self.references)
        if self.deletions:
            gone = self._read(f"doc {self.id_type}, step int", *self.deletions).withColumnsRenamed({"doc": "_doc", "step": "_step"})
            rows = rows.join(gone, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("step") < F.col("_step")), "left_anti")
        return rows.drop("step")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with these documents too.

        Rows that share an id are one document; rows without an id are one together, behind all
        others. Only keys that the filters may know are looked up in the counts.
        """
        made = line_references(docs, self.least, id_col, text_col).withColumn("step", F.lit(self.step))
        path = self._write(made, "line-references")
        after = replace(self, references=(*self.references, path), step=self.step + 1)
        keys = materialise(_counted(self.stored_references(path)), "line-keys")
        if self.counts is None:
            shards = self.shards or max(1, -(-keys.count() // SHARD_KEYS))
            after = replace(after, shards=shards, counts=self._write(keys, "line-counts"))
            new = keys
        else:
            counts = self.stored_counts()
            maybe = materialise(_through_filters(after, keys, "probe"), "line-maybe")
            known = materialise(counts.join(maybe, _KEY, "left_semi"), "line-known")
            new = keys.join(known, _KEY, "left_anti")
            both = _merged(known.unionByName(keys.join(known, _KEY, "left_semi")))
            whole = counts.join(known, _KEY, "left_anti").unionByName(both).unionByName(new)
            after = replace(after, counts=self._write(whole, "line-counts"))
        return replace(after, filters=self._write(_through_filters(after, new, "add"), "line-filters"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose id is in the only column of `ids`, as if they had never come.

        Counts of the keys they hold are made anew from what is left; keys that nothing holds any
        more leave the counts and the filters. Unknown ids change nothing.
        """
        if self.counts is None:
            return self
        gone = materialise(ids.select(F.col(ids.columns[0]).cast(self.id_type).alias("doc")).distinct(), "line-gone")
        held = self.live_references()
        keys = held.join(gone.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")), "left_semi").select(*_KEY).distinct()
        keys = materialise(keys, "line-touched")
        path = self._write(gone.withColumn("step", F.lit(self.step)), "line-deletions")
        after = replace(self, deletions=(*self.deletions, path), step=self.step + 1)
        # A hot key's references are dealt out by salt before they are put together.
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        left = after.live_references().withColumn("salt", F.pmod(F.xxhash64("doc", "tag"), F.lit(_SALTS)).cast("int"))
        left = left.join(salted, [*_KEY, "salt"], "left_semi").groupBy(*_KEY, "salt").agg(
            F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("no_id"))
        counted = materialise(_merged(left), "line-left")
        counts = self.stored_counts()
        whole = counts.join(keys, _KEY, "left_anti").unionByName(counted)
        lost = keys.join(counted, _KEY, "left_anti")
        filters = self._write(_through_filters(after, lost, "remove"), "line-filters")
        return replace(after, counts=self._write(whole, "line-counts"), filters=filters)

    def repeated(self) -> DataFrame:
        """h1, h2, first: the keys that at least two documents hold, and the smallest of them."""
        several = (F.col("first") != F.col("last")) | (F.col("no_id") & F.col("first").isNotNull())
        return self.stored_counts().filter(several).select(*_KEY, "first")


def empty_index(docs: DataFrame, id_col: str = "doc_id", **settings) -> LineIndex:
    """An index without documents, for ids of the type that `docs` has."""
    return LineIndex(docs.sparkSession, docs.schema[id_col].dataType.simpleString(), **settings)


def _cut_lines(text: str | None, drop: list[dict] | None, least: int) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if not drop:
        return len(lines), 0, text or ""
    gone = set(np.array([(k["h1"], k["h2"]) for k in drop], "<i8").tobytes()[i:i + 16] for i in range(0, 16 * len(drop), 16))
    kept = [line for line, key in zip(lines, _line_keys(text, least), strict=True) if key not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedupe_lines(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_lines, n_dropped and kept, the text without lines that an earlier document holds.

    `docs` must have been inserted. Texts are split at line feeds; a null or empty text is one
    empty line. A key, which is a line without white space at its ends and with A-Z lowered,
    counts from `index.least` code points on; if several documents hold it, all but the smallest
    lose all its lines, repeated ones within a document too. Shorter lines stay. Rows that share an
    id are one document and keep what only they hold; rows without an id lose what any other holds.
    Other columns are not read; an empty table gives an empty one.
    """
    rows = index.live_references().join(index.repeated(), _KEY).filter(~F.col("doc").eqNullSafe(F.col("first")))
    # Bounded by the lines of one text.
    drops = materialise(rows.groupBy("doc", "tag").agg(F.collect_list(F.struct(*_KEY)).alias("drop")), "line-drops")
    drops = drops.withColumnsRenamed({"doc": "_doc", "tag": "_tag"})
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce(F.col("_text"), F.lit(""))) == F.col("_tag"))
    schema = f"{id_col} {index.id_type}, n_lines long, n_dropped long, kept string"
    least = index.least

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = [_cut_lines(text, drop, least) for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        columns = [list(c) for c in zip(*cut, strict=True)] if cut else [[], [], []]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.string())], [id_col, "n_lines", "n_dropped", "kept"])

    return map_batches(texts.join(drops, same, "left").select("_id", "_text", "drop"), run, schema, rows=256)


def dedupe_in_steps(docs: DataFrame, steps: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Inserts all documents, dealt over `steps` by their ids, and cuts their lines: the same for any number of steps."""
    index = empty_index(docs, id_col)
    share: Column = F.pmod(F.xxhash64(F.col(id_col)), F.lit(steps))
    for step in range(steps):
        index = index.insert(docs.filter(share == step), id_col, text_col)
    return dedupe_lines(index, docs, id_col, text_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedupe_in_steps with a digest in place of the text."""
    return dedupe_in_steps(docs, id_col=id_col, text_col=text_col).select(
        id_col, "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))

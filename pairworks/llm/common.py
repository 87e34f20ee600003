"""What the operators of this package share."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from pairworks.plans.shared import materialise, new_path  # noqa: F401

# What counts as white space between words, as a Java and DuckDB pattern: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
MOST_BYTES = 8_000_000


def fresh_name(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has, in letters of either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_all_remembered: weakref.WeakSet[Remembered] = weakref.WeakSet()
_at_work = ""  # the module of the operator whose tasks this Python worker has had last


class Remembered:
    """Values of short texts, worked out many at a time and kept for up to `entries` of them.

    When it is full it starts again, so that memory stays bounded and frequent texts come back.
    A Python worker that goes on with another operator forgets them, see `map_batches`.
    """

    def __init__(self, work_out: Callable[[list[str]], Iterable], entries: int = 400_000, longest: int = 64):
        self.work_out, self.entries, self.longest = work_out, entries, longest
        self._known: dict = {}
        _all_remembered.add(self)

    def forget(self) -> None:
        self._known = {}

    def look_up(self, lists: list[list[str]]) -> list[list]:
        """The values of all texts of all lists."""
        get = self._known.get
        found = [list(map(get, keys)) for keys in lists]
        new = list({k for keys, values in zip(lists, found, strict=True) if None in values
                    for k, v in zip(keys, values, strict=True) if v is None})
        if not new:
            return found
        fresh = dict(zip(new, self.work_out(new), strict=True))
        out = [[fresh[k] if v is None else v for k, v in zip(keys, values, strict=True)] if None in values else values
               for keys, values in zip(lists, found, strict=True)]
        if len(self._known) + len(fresh) > self.entries:
            self._known.clear()
        self._known.update((k, v) for k, v in fresh.items() if len(k) <= self.longest)
        return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType,
                rows: int = 512, size: int = MOST_BYTES) -> DataFrame:
    """`fn` on Arrow batches of at most `rows` rows and, but for a single row, `size` bytes, so that a
    task holds few whole texts at a time.

    Python workers outlive a task, and what they remember for one operator is forgotten when they
    get the first task of another one: else a job of many steps would hold that of all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_pieces(fn, batches, rows, size)

    return df.mapInArrow(run, schema)


def _in_pieces(fn: Callable[[pa.RecordBatch], pa.RecordBatch], batches: Iterable[pa.RecordBatch],
               rows: int, size: int) -> Iterator[pa.RecordBatch]:
    _turn_to(fn.__module__)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield from map(fn, _no_larger(batch.slice(start, rows), size))


def _no_larger(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch, or its halves and theirs, until each has one row or at most `size` bytes."""
    if batch.num_rows <= 1 or batch.nbytes <= size:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _no_larger(batch.slice(0, half), size)
        yield from _no_larger(batch.slice(half), size)


def _turn_to(operator: str) -> None:
    global _at_work
    if operator != _at_work:
        for remembered in list(_all_remembered):
            remembered.forget()
        _at_work = operator

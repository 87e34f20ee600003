"""The newest rows of every key, as a stream: what is older than what has been seen stays out.

Spark's state store holds the orders of the newest rows per key, and no rows. A row goes on if
it is among the newest so far, so that the batch operators, over all rows that went on, give what
they give over all rows. The output is an append-only Parquet folder, exactly once by Spark's
file sink. The state of a key that has ended is dropped after a while; rows that come later yet
go on as well, and change the result only if they are newer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KEEP_ENDED_MS = 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
LEAST_PARTITIONS = 16
THIN_ROWS = 100_000
THIN_BYTES = 32_000_000


class Newest(StatefulProcessor):
    """Lets the n newest rows of a key through, and those marked `_always`.

    A list state holds the orders of the n newest. While the newest row of all is marked `_ends`,
    a timer runs, at whose end the state is dropped.
    """

    def __init__(self, n: int, keep_ms: int, ending: bool = True):
        self.n, self.keep_ms, self.ending = n, keep_ms, ending

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._orders = handle.getListState("orders", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        # Every call goes to the JVM and back, and there is a key for every few rows: none is made in vain.
        known = [at for (at,) in self._orders.get()]
        # Rows come in any order: the newest n of this micro-batch are told apart before the state is asked.
        come = list(rows)
        newest = sorted([*known, *(row["_order"] for row in come)], reverse=True)[:self.n]
        if newest != known:
            self._orders.put([(at,) for at in newest])
        latest = max(come, key=lambda row: row["_order"]) if self.ending else None
        if latest and latest["_order"] >= newest[0]:
            # A timer goes together with the state: a key without one has no other.
            for timer in list(self._handle.listTimers()) if known else ():
                self._handle.deleteTimer(timer)
            if latest["_ends"]:
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        for row in come:
            if row["_order"] >= newest[-1] or row["_always"]:
                yield row

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        self._orders.clear()
        return iter(())

    def close(self) -> None:
        pass


def _thin(batch: pa.RecordBatch, key: str, n: int, marks: tuple[str, ...] = ("_ends", "_always")) -> pa.RecordBatch:
    """The rows of a batch that may be among the n newest of their key, so that a key which floods the
    log brings n rows per batch to its state and no more; rows with a mark stay."""
    keys = batch.column(batch.schema.get_field_index(key)).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = batch.column(batch.schema.get_field_index("_order")).to_numpy()
    by_age = np.lexsort((-order, keys))
    sorted_keys, sorted_order = keys[by_age], order[by_age]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
    last = np.minimum(starts + n, np.r_[starts[1:], len(keys)]) - 1
    keep = np.zeros(len(keys), bool)
    keep[by_age] = sorted_order >= sorted_order[last][group]
    for name in marks:
        keep |= batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(keep))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to THIN_ROWS or THIN_BYTES, so that more of a key's rows meet before the shuffle."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (rows + batch.num_rows > THIN_ROWS or size + batch.nbytes > THIN_BYTES):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.concat_batches(held)


def newest_rows(rows: DataFrame, key: str, order: Column, n: int = 1, ends: Column | None = None,
                always: Column | None = None, keep_ms: int = KEEP_ENDED_MS) -> DataFrame:
    """The rows of a stream that were among the n newest of their key when they came.

    `order` is a whole number; rows without one stay out, ties go on. `ends` marks a row after
    which its key's state may be dropped, `always` rows that go on however old they are.
    """
    false = F.lit(False)
    marked = rows.withColumns({
        "_order": order.cast("bigint"), "_ends": F.coalesce(ends if ends is not None else false, false),
        "_always": F.coalesce(always if always is not None else false, false)}).filter("_order IS NOT NULL")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            # Only the newest row of all can end a key, and it is kept as such.
            yield _thin(batch, key, n, ("_always",))

    kept = marked.mapInArrow(thin, marked.schema).groupBy(key).transformWithState(
        Newest(n, keep_ms, ends is not None), marked.schema, "Append", "ProcessingTime")
    return kept.drop("_order", "_ends", "_always")


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def state_partitions(spark: SparkSession) -> int:
    """Two state partitions per core, LEAST_PARTITIONS at least and no more than shuffles have.

    A partition costs a Python worker and a commit of its state store in every micro-batch, about a
    second, however little it holds, and a key's state is a few numbers: more partitions than the
    cores can work on only add to the time.
    """
    return min(int(spark.conf.get(_PARTITIONS)), max(2 * spark.sparkContext.defaultParallelism, LEAST_PARTITIONS))


def start_newest(rows: DataFrame, path: str, checkpoint: str, once: bool = False, every: str | None = None,
                 partitions: int | None = None) -> StreamingQuery:
    """Appends the rows of `newest_rows` to the Parquet folder `path`, from where `checkpoint` left off.

    With `once` the stream ends when it has taken all that is there. Timers then run out in the
    first micro-batch with rows after their time, as empty ones would never end. `every` is the
    time from one micro-batch to the next; without it one follows the other. `partitions` is the
    number of state partitions, which a checkpoint keeps from its first start on.
    """
    spark = rows.sparkSession
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    settings = {_PROVIDER: _ROCKS, _CHANGELOG: "true", _PARTITIONS: str(partitions or state_partitions(spark))} | ({_EMPTY_BATCHES: "false"} if once else {})
    with _settings(spark, **settings):
        if once:
            writer = writer.trigger(availableNow=True)
        elif every:
            writer = writer.trigger(processingTime=every)
        return writer.start()

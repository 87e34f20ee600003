"""Monitoring as streams.

`parse_log_stream` and `parse_messages` take streaming frames as they are. The functions here keep
what their batch counterparts need: `latest_metrics`, `run_status`, `latest_file_sizes` and
`recent_logs` over the folder they append to give what they give over all events so far. All order
by a position in the data, so late and repeated rows change nothing, and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairworks.functions import fixed_values as fixed
from pairworks.operators.monitor import metric_events
from pairworks.sources.folders import watch_sizes
from pairworks.streaming.newest import KEEP_ENDED_MS, newest_rows, start_newest

LINE_SCHEMA = "run_id string, seq bigint, line string, channel string"


def read_log_lines(spark: SparkSession, path: str, schema: str = LINE_SCHEMA) -> DataFrame:
    """A folder of JSON files as a stream of log lines; every line has run_id and seq."""
    return spark.readStream.schema(schema).json(path)


def start_metrics(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the metrics that were the latest of their run when they came."""
    return start_newest(newest_rows(metric_events(events), "run_id", F.col("seq")), path, checkpoint, once)


def start_status(events: DataFrame, path: str, checkpoint: str, once: bool = False,
                 keep_ms: int = KEEP_ENDED_MS) -> StreamingQuery:
    """Appends the status events that were the latest of their run when they came, and all that tell of a kill.

    The state of a run that has ended is dropped after `keep_ms`.
    """
    rows = newest_rows(events, "run_id", F.col("seq"), ends=~F.col("running"), always=F.col("killed"), keep_ms=keep_ms)
    return start_newest(rows, path, checkpoint, once)


def start_file_sizes(events: DataFrame, path: str, checkpoint: str, order: str = "ts", once: bool = False) -> StreamingQuery:
    """Appends the sizes that were the latest of their file when they came."""
    return start_newest(newest_rows(events, "file", F.unix_micros(F.col(order).cast("timestamp"))), path, checkpoint, once)


def start_watched_sizes(spark: SparkSession, roots: str | list[str], path: str, checkpoint: str, glob: str | None = None,
                        ignore_initial: bool = True, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Appends the sizes of files below `roots` that are added or change, as `latest_file_sizes` takes them."""
    return start_newest(watch_sizes(spark, roots, glob, ignore_initial), path, checkpoint, once, every)


def start_recent_logs(events: DataFrame, path: str, checkpoint: str, n: int = fixed.LOG_TAIL, once: bool = False) -> StreamingQuery:
    """Appends the events that were among the last n of their run when they came."""
    return start_newest(newest_rows(events, "run_id", F.col("seq"), n), path, checkpoint, once)

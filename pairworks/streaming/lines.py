"""Lines out of a process's output as it comes, cut anywhere."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINES = "run_id {run}, channel string, line_no bigint, line string"


class Tail(StatefulProcessor):
    """Keeps, per run and channel, the number of lines so far and the text of the one that has not ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tail = handle.getValueState("tail", "lines bigint, text string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        count, text = self._tail.get() if self._tail.exists() else (0, "")
        parts = [text]
        for row in sorted(rows, key=lambda row: row["seq"]):
            first, *more = (row["data"] or "").split("\n")
            parts.append(first)
            for piece in more:
                count += 1
                yield Row(run_id=key[0], channel=key[1], line_no=count, line="".join(parts))
                parts = [piece]
        self._tail.update((count, "".join(parts)))

    def close(self) -> None:
        pass


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(run_id, channel, line_no, line) of a stream of (run_id, channel, seq, data): the lines that have ended.

    Chunks may come in any order within a micro-batch, and later micro-batches hold later ones. What
    has no line feed yet is kept in the state store over micro-batches and restarts. The result goes to
    `start_newest`'s sink or any other that appends.
    """
    kind = chunks.schema["run_id"].dataType.simpleString()
    return chunks.select("run_id", "channel", "seq", "data").groupBy("run_id", "channel").transformWithState(
        Tail(), LINES.format(run=kind), "Append", "None")

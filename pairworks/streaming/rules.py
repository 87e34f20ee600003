"""The rule log as a stream, and chats routed by the rules of the moment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pairworks.operators.chats import answer_chats
from pairworks.operators.completion import Client
from pairworks.operators.rules import apply_rule_changes, changed_ids, route_requests
from pairworks.plans.shared import materialise, temporary_tables
from pairworks.streaming.batches import BatchTable


def start_rule_changes(
    changes: DataFrame, table: BatchTable, rejects: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Applies each micro-batch to the rules in `table`, whose key is id; rejects go to a folder per
    micro-batch. Rules of other ids are neither shuffled nor written.

    Later micro-batches must hold later `seq`s.
    """
    def apply(batch: DataFrame, number: int) -> None:
        with temporary_tables(table.spark):
            # Each of these is read several times over.
            new = materialise(batch, "rule-changes")
            touched = materialise(changed_ids(new), "touched-ids")
            found = materialise(table.before(number, touched), "touched-rules")
            rules, refused = apply_rule_changes(found, new)
            refused.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
            table.put(number, rules, touched)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_routing(
    requests: DataFrame, table: BatchTable, output: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Routes chat requests; each micro-batch reads the rules anew."""
    def route(batch: DataFrame, number: int) -> None:
        with temporary_tables(table.spark):
            routed, refused = route_requests(batch, table.latest())
            routed.write.mode("overwrite").parquet(f"{output}/routed/batch={number}")
            refused.write.mode("overwrite").parquet(f"{output}/rejected/batch={number}")

    writer = requests.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_answering(
    requests: DataFrame, table: BatchTable, client_factory: Callable[[], Client], output: str, ledger: str, checkpoint: str,
    once: bool = False, **options
) -> StreamingQuery:
    """Answers chat requests, a partition per micro-batch below `output`; each micro-batch reads the rules anew.

    A micro-batch that runs again makes only the calls that have no reply in the ledger.
    """
    def answer(batch: DataFrame, number: int) -> None:
        with temporary_tables(table.spark):
            answers = answer_chats(batch, table.latest(), client_factory, path=ledger, **options)
            answers.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Model search and the history of models used."""

from __future__ import annotations

import re

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed
from pairworks.plans.running import CHUNK, cut, long_keys, previous
from pairworks.plans.shared import materialise


def search_limit(value: str | int | None, most: int | None = fixed.MAX_SEARCH_LIMIT) -> int:
    """The leading whole number of a limit; the default if there is none or it is out of range."""
    found = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    limit = int(found[1]) if found else 0
    return limit if 0 < limit and (most is None or limit <= most) else fixed.DEFAULT_SEARCH_LIMIT


def search_models(
    catalog: DataFrame, query: str = "", limit: str | int | None = None,
    tag: str = fixed.SEARCH_TAG, most: int | None = fixed.MAX_SEARCH_LIMIT,
) -> DataFrame:
    """Models of a kind whose id holds the query, most downloads first.

    Sorting with a limit keeps the best few per task and merges those.
    """
    found = F.contains(F.lower("id"), F.lit(query.lower()))
    return (
        catalog.filter((F.col("pipeline_tag") == tag) & found)
        .orderBy(F.col("downloads").desc(), "id").limit(search_limit(limit, most))
    )


def recent_models(
    saves: DataFrame, n: int = fixed.HISTORY_LENGTH, chunk: int = CHUNK
) -> DataFrame:
    """(user, position, model): every user's last n new models, newest first, from (user, seq, model).

    A model enters at the front unless it is listed already, and the list keeps n. Users with up
    to n models never drop one, so the first use of each model settles their list, by counting
    alone. Only for users with more are the saves gone through in order, see `_replay`.
    """
    named = saves.filter(F.coalesce(F.col("model"), F.lit("")) != "").select("user", "seq", "model")
    uses = named.groupBy("user", "model").agg(F.min("seq").alias("first"))
    many = materialise(
        uses.groupBy("user").agg(F.count("*").alias("_models")).filter(F.col("_models") > n)
        .select("user"), "busy-users")
    newest = Window.partitionBy("user").orderBy(F.col("first").desc())
    settled = uses.join(many, "user", "left_anti").select(
        "user", F.row_number().over(newest).alias("position"), "model")
    if many.isEmpty():
        return settled
    replayed = _replay(named.join(many, "user", "left_semi"), n, chunk).select(
        "user", F.posexplode("models").alias("position", "model"))
    return settled.unionByName(replayed.withColumn("position", F.col("position") + 1))


def _replay(saves: DataFrame, n: int, chunk: int) -> DataFrame:
    """(user, models) by going through the saves.

    A task goes through one chunk of a user's saves with the list as its only state. A user with
    more than one chunk starts every chunk from an empty list; chunks whose start turns out to
    differ from the end of the chunk before are gone through again until none is left. The lists
    of a chunk soon agree whatever it started from if there are many models; with barely more
    than n it can take a round per chunk.
    """
    long = long_keys(saves, ["user"], "seq", chunk)
    chunks = cut(saves, ["user"], "seq", long)
    rows = previous(chunks, "seq", {"_last": "model"}, long).filter(
        F.col("_last").isNull() | (F.col("_last") != F.col("model"))
    ).select("user", "_chunk", "seq", "model")
    if long is not None:
        rows = materialise(rows, "saves")
    key = ["user", "_chunk"]
    first = rows.repartition(*key).sortWithinPartitions(*key, "seq")
    columns = f"user {saves.schema['user'].dataType.simpleString()}, _chunk bigint, models array<string>"
    ends = first.mapInArrow(_from_empty(n), columns)
    if long is None:
        return ends.select("user", "models")

    empty = F.array().cast("array<string>")
    ends = materialise(ends.withColumn("start", empty), "lists")
    while True:
        before = F.lag("models").over(Window.partitionBy("user").orderBy("_chunk"))
        states = ends.withColumn("wanted", F.coalesce(before, empty))
        stale = materialise(
            states.filter(F.col("wanted") != F.col("start")).select(*key, "wanted"), "stale")
        if stale.isEmpty():
            return ends.groupBy("user").agg(F.max_by("models", "_chunk").alias("models"))
        again = rows.join(stale, key, "left_semi").groupBy(*key).cogroup(
            stale.groupBy(*key)).applyInArrow(_from_start(n), f"{columns}, start array<string>")
        ends = materialise(ends.join(stale, key, "left_anti").unionByName(again), "lists")


def _enter(listed: list[str], model: str, n: int) -> list[str]:
    return listed if model in listed else [model, *listed][:n]


def _lists(done: list[tuple], columns: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(columns, row)) for row in done], schema)


def _from_empty(n: int):
    columns = ["user", "_chunk", "models"]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, listed, done, schema = None, [], [], None
        for batch in batches:
            schema = pa.schema([
                batch.schema.field("user"), batch.schema.field("_chunk"), ("models", pa.list_(pa.string()))])
            rows = zip(*(batch.column(c).to_pylist() for c in ("user", "_chunk", "model")))
            for user, chunk, model in rows:
                if (user, chunk) != current:
                    if current is not None:
                        done.append((*current, listed))
                    current, listed = (user, chunk), []
                listed = _enter(listed, model, n)
            yield _lists(done, columns, schema)
            done = []
        if current is not None:
            yield _lists([(*current, listed)], columns, schema)
    return lists


def _from_start(n: int):
    def lists(saves: pa.Table, starts: pa.Table) -> pa.Table:
        start = starts.column("wanted")[0].as_py()
        listed = start
        for model in saves.sort_by("seq").column("model").to_pylist():
            listed = _enter(listed, model, n)
        names = pa.list_(pa.string())
        return pa.table({
            "user": starts.column("user").slice(0, 1), "_chunk": starts.column("_chunk").slice(0, 1),
            "models": pa.array([listed], names), "start": pa.array([start], names)})
    return lists

"""Raw rows to {input, target} pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairworks.functions.text import py_strip, with_json
from pairworks.plans.running import CHUNK, cut, long_keys, previous

Fields = dict[str, tuple[Column, Column, Column]]


def normalize_pairs(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`input` and `target` from whichever of the usual column names the source has.

    Which columns are there decides the mapping, as does whether `input` holds anything; a null
    value gives an empty text. `keep` names columns to carry along (all unmapped ones if None).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = {
        name: (F.lit(True), _truthy(F.col(name), types[name]), _text(F.col(name), types[name]))
        for name in _MAPPED if name in types
    }
    if keep is None:
        keep = [c for c in df.columns if c not in _MAPPED]
    source, target = _mapping(fields)
    return df.select(*keep, source.alias("input"), target.alias("target"))


def normalize_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The same mapping for JSON objects whose fields differ from row to row."""
    parsed = with_json(df, "_json", F.col(column))
    fields = {}
    for name in _MAPPED:
        value = F.try_variant_get("_json", f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        text = F.try_variant_get("_json", f"$.{name}", "string")
        truthy = (
            F.when(value.isNull() | F.is_variant_null(value), False)
            .when(kind == "BOOLEAN", text == "true")
            .when(kind == "STRING", text != "")
            .when(text.isin("[]", "{}"), False)
            .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
        )
        shown = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
        fields[name] = (value.isNotNull(), truthy, F.coalesce(shown, F.lit("")))
    source, target = _mapping(fields)
    return parsed.select(*keep, source.alias("input"), target.alias("target"))


_MAPPED = ("instruction", "input", "act", "prompt", "target", "output", "response")


def _mapping(fields: Fields) -> tuple[Column, Column]:
    never = (F.lit(False), F.lit(False), F.lit(""))

    def has(name: str) -> Column:
        return fields.get(name, never)[0]

    def filled(name: str) -> Column:
        return fields.get(name, never)[1]

    def text(name: str) -> Column:
        return fields.get(name, never)[2]

    instructed = F.when(
        filled("instruction"), F.concat(text("instruction"), F.lit("\n"), text("input"))
    ).otherwise(text("input"))
    source = (
        F.when(filled("input"), instructed)
        .when(has("instruction"), text("instruction"))
        .when(has("act"), F.concat(F.lit("Act as "), text("act")))
        .when(has("prompt"), text("prompt"))
        .otherwise("")
    )
    target = (
        F.when(has("target"), text("target"))
        .when(has("output"), text("output"))
        .when(has("response"), text("response"))
        .when(has("prompt") & has("act"), text("prompt"))
        .otherwise("")
    )
    return py_strip(source), py_strip(target)


def _truthy(col: Column, type_: T.DataType) -> Column:
    if isinstance(type_, T.StringType):
        held = col != ""
    elif isinstance(type_, T.BooleanType):
        held = col
    elif isinstance(type_, T.NumericType):
        held = col != 0
    elif isinstance(type_, (T.ArrayType, T.MapType)):
        held = F.size(col) > 0
    else:
        held = col.isNotNull()
    return F.coalesce(held, F.lit(False))


def _text(col: Column, type_: T.DataType) -> Column:
    if isinstance(type_, T.BooleanType):
        col = F.initcap(col.cast("string"))
    elif isinstance(type_, (T.ArrayType, T.MapType, T.StructType)):
        col = F.to_json(col)
    return F.coalesce(col.cast("string"), F.lit(""))


def is_complete() -> Column:
    """Whether a row has both texts; null counts as missing."""
    return (F.coalesce(F.col("input"), F.lit("")) != "") & (
        F.coalesce(F.col("target"), F.lit("")) != "")


def keep_valid(df: DataFrame) -> DataFrame:
    return df.filter(is_complete())


def import_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows kept and skipped per dataset."""
    return df.groupBy(*keys).agg(
        F.count_if(is_complete()).alias("count"), F.count_if(~is_complete()).alias("skipped"))


def transform_sql(df: DataFrame, source: str, target: str, keep: list[str]) -> DataFrame:
    """Pairs by SQL expressions over the raw columns."""
    return df.select(*keep, F.expr(source).alias("input"), F.expr(target).alias("target"))


def transform_rows(
    df: DataFrame,
    transform: Callable[[dict[str, Any]], dict[str, Any] | None],
    keep: list[str],
) -> DataFrame:
    """Pairs by a Python function from a row to {input, target}, or None for an invalid row.

    An exception is caught per row and reported in `error`; such a row has null texts.
    """
    schema = T.StructType([
        *[df.schema[k] for k in keep],
        T.StructField("input", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("error", T.StringType()),
    ])

    def one(row: dict[str, Any]) -> tuple[str | None, str | None, str | None]:
        try:
            pair = transform(row) or {}
            return (*(None if pair.get(k) is None else str(pair[k]) for k in ("input", "target")), None)
        except Exception as error:  # noqa: BLE001  a bad row must not end the job
            return None, None, f"{type(error).__name__}: {error}"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [one(row) for row in batch.to_pylist()]
            columns = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *(pa.array(c, pa.string()) for c in columns)],
                names=[*keep, "input", "target", "error"])

    return df.mapInArrow(batches, schema)


def chat_to_pairs(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", chunk: int = CHUNK
) -> DataFrame:
    """A pair per assistant message that follows a user message."""
    long = long_keys(df, [conversation], turn, chunk)
    messages = cut(df.select(conversation, turn, "role", "text"), [conversation], turn, long)
    turns = previous(messages, turn, {"_role": "role", "_text": "text"}, long)
    return turns.filter((F.col("role") == "assistant") & (F.col("_role") == "user")).select(
        conversation, turn,
        F.concat(F.lit("User: "), F.col("_text"), F.lit(" \n")).alias("input"),
        F.col("text").alias("target"))

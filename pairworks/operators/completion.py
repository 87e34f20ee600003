"""Model calls in batch, and the synthetic variations made with them."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import evaluated, fill, strip_fences, with_json
from pairworks.plans.shared import materialise, new_path

Client = Callable[[str, float, float], str]
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 1_000_000
_REPLY = {"reply": "string", "error": "string", "status": "int"}


class ModelError(RuntimeError):
    """A reply that is none; `status` is the one the model API gave."""

    def __init__(self, status: int, body: str):
        super().__init__(f"model API returned {status}: {body}")
        self.status = status


def read_completion(status: int, body: str) -> str:
    """The text of a chat-completion reply; raises on anything but a usable one."""
    if not 200 <= status < 300:
        raise ModelError(status, body)
    choices = json.loads(body).get("choices")
    if not isinstance(choices, list) or not choices:
        raise RuntimeError("reply has no choices")
    content = (choices[0].get("message") or {}).get("content")
    if not content:
        raise RuntimeError("reply has no message content")
    return content


class HttpChat:
    """Client factory for an OpenAI-style chat endpoint; called once per partition.

    A prompt is a user's message, or with `as_messages` the JSON of a whole chat's messages.
    Further settings go into every request; predictions to be scored want
    max_tokens=MAX_NEW_TOKENS and stop=STOP_SEQUENCES.
    """

    def __init__(self, base_url: str, as_messages: bool = False, **settings):
        self.url = f"{base_url.rstrip('/')}/v1/chat/completions"
        self.as_messages = as_messages
        self.settings = settings

    def __call__(self) -> Client:
        def call(prompt: str, temperature: float, timeout: float) -> str:
            messages = json.loads(prompt) if self.as_messages else [{"role": "user", "content": prompt}]
            body = json.dumps({
                "messages": messages, "temperature": temperature, "stream": False, **self.settings,
            }).encode()
            request = urllib.request.Request(
                self.url, body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    return read_completion(reply.status, reply.read().decode())
            except urllib.error.HTTPError as refused:
                raise ModelError(refused.code, refused.read().decode("utf-8", "replace")) from refused
        return call


def _parts(batch: pa.RecordBatch, prompt: str, least: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of up to ROWS_AT_ONCE rows and about BYTES_AT_ONCE of prompts, and of `least` rows where prompts
    are long: prompts and replies are held for a part at a time, however many rows Spark sends at once."""
    start = 0
    while start < batch.num_rows:
        sizes = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(prompt).slice(start, max(ROWS_AT_ONCE, least))), 0).cast(pa.int64()))
        within = pc.sum(pc.less_equal(sizes, BYTES_AT_ONCE)).as_py()
        yield batch.slice(start, max(within, least))
        start += max(within, least)


def complete(
    df: DataFrame,
    prompt: str,
    client_factory: Callable[[], Client],
    temperature: float = 0.0,
    timeout: float = fixed.COMPLETION_TIMEOUT_SECONDS,
    partitions: int | None = None,
    calls_per_task: int = 1,
) -> DataFrame:
    """Adds `reply`, `error` and `status` by one call per row; a failed call fails only its row.

    The status is 200, the one that the model API gave, or 500 for any other failure. `partitions` and `calls_per_task` bound the calls at a time; a client must be thread-safe if
    a task makes several. The frame is lazy and models do not repeat themselves: store the
    result before using it twice, see `complete_once`.
    """
    schema = T.StructType([
        *df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("status", T.IntegerType())])

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()

        def one(text: str) -> tuple[str | None, str | None, int]:
            try:
                return client(text, temperature, timeout), None, 200
            except Exception as error:  # noqa: BLE001  a failed call must not end the job
                return None, f"{type(error).__name__}: {error}", getattr(error, "status", 500)

        with ThreadPoolExecutor(calls_per_task) as pool:
            for batch in (part for whole in batches for part in _parts(whole, prompt, calls_per_task)):
                answers = list(pool.map(one, batch.column(prompt).to_pylist()))
                replies, errors, statuses = zip(*answers) if answers else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(statuses, pa.int32())],
                    names=[*batch.schema.names, *_REPLY])

    spread = df.repartition(partitions) if partitions else df
    return spread.mapInArrow(calls, schema)


@dataclass(frozen=True)
class Ledger:
    """The replies that have been asked for, by digest of the call: Parquet that is only ever appended to.

    A task's replies are there as soon as the task has ended, also if the job around it breaks
    off later. A task that runs twice may leave its replies twice; `best` has one per call.
    """

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        schema = ", ".join(f"{name} {kind}" for name, kind in {"_call": "string", **_REPLY}.items())
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def append(self, replies: DataFrame) -> None:
        # With this version of Hadoop's committer a task's file is in place when the task is committed.
        replies.select("_call", *_REPLY).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)


def _best(replies: DataFrame) -> DataFrame:
    """One reply per call: a usable one if there is any."""
    told = F.struct(F.col("error").isNull().alias("good"), *_REPLY)
    return replies.groupBy("_call").agg(F.max(told).alias("_told")).select("_call", *[f"_told.{name}" for name in _REPLY])


def complete_once(
    df: DataFrame,
    keys: list[str],
    prompt: str,
    client_factory: Callable[[], Client],
    done: DataFrame | None = None,
    path: str | None = None,
    **options,
) -> DataFrame:
    """`complete` for calls that cost: `df` with prompt_hash, reply, error and status, stored.

    A call is its row's keys and prompt. Each different call is made once and its reply entered in
    a ledger at `path`, task by task: after a failure, and with more, fewer or changed rows, a run
    makes the calls that have no usable reply there yet and no others, and every row of `df` comes
    back with the reply to its call. `done` is an earlier result whose usable replies count as
    well. Rows with equal keys and prompts share a reply; null keys are equal. `df` is read twice.
    Prompts are dealt out evenly by the digests of the calls.
    """
    spark = df.sparkSession
    ledger = Ledger(spark, path or new_path(spark, "ledger"))

    def identified(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_call", F.sha2(F.to_json(F.struct(*keys, "prompt_hash")), 256))

    marked = identified(df.withColumn("prompt_hash", F.sha2(F.col(prompt), 256)))
    earlier = None
    if done is not None:
        status = {} if "status" in done.columns else {"status": F.lit(200)}
        earlier = identified(done.withColumns(status) if status else done).filter(F.col("error").isNull()).select("_call", *_REPLY)

    def replies() -> DataFrame:
        return ledger.rows() if earlier is None else ledger.rows().unionByName(earlier)

    asked = marked.groupBy("_call").agg(F.first(prompt).alias("_prompt"))
    answered = replies().filter(F.col("error").isNull()).select("_call")
    ledger.append(complete(asked.join(answered, "_call", "left_anti"), "_prompt", client_factory, **options))
    return materialise(marked.join(_best(replies()), "_call", "left").drop("_call"), "replies")


def variation_prompts(seeds: DataFrame, max_count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(seeds with `prompt`, rejected) for (seed_input, seed_output, count).

    With `max_count`, higher counts are lowered to it, and `count_lowered` says so.
    """
    def given(name: str, empty) -> Column:
        return F.coalesce(F.col(name) != F.lit(empty), F.lit(False))

    complete_seed = given("seed_input", "") & given("seed_output", "") & given("count", 0)
    rejected = seeds.filter(~complete_seed).withColumns({
        "error_code": F.lit("INVALID_INPUT"), "error_message": F.lit("Missing fields")})
    capped = seeds.filter(complete_seed)
    if max_count is not None:
        capped = capped.withColumns({
            "count_lowered": F.col("count") > max_count, "count": F.least("count", F.lit(max_count))})
    asked = fill(
        fixed.VARIATION_TEMPLATE, count=F.col("count").cast("string"),
        seed_input=F.col("seed_input"), seed_output=F.col("seed_output"))
    return capped.withColumn("prompt", asked), rejected


def parse_variations(replies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(variations, rejected): a row per object of a reply, in its order (`variation`, from 0).

    All objects count, also beyond the number asked for; absent texts are null.
    """
    parsed = with_json(replies, "_json", strip_fences(F.col("reply")))
    listed = evaluated(parsed, "_items", F.try_variant_get("_json", "$", "array<variant>"))
    usable = F.col("_items").isNotNull()
    rows = listed.filter(usable).select(*keys, F.posexplode("_items").alias("variation", "_item"))
    rejected = listed.filter(~usable).select(
        *keys, "reply", F.lit("INTERNAL_ERROR").alias("error_code"),
        F.lit("Generation failed").alias("error_message"))
    return rows.select(
        *keys, "variation",
        F.try_variant_get("_item", "$.input", "string").alias("input"),
        F.try_variant_get("_item", "$.target", "string").alias("target")), rejected

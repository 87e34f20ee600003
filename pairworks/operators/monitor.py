"""Training logs, file sizes and run status; see streaming.monitor for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import to_exponential, to_fixed, with_json
from pairworks.plans.running import CHUNK, cut, long_keys, running

METRICS = ("loss", "grad_norm", "learning_rate", "epoch")


def parse_log_stream(lines: DataFrame) -> DataFrame:
    """(run_id, seq, kind, metrics, text) of (run_id, seq, line[, channel]).

    `channel` is stdout (the default), stderr, or spawn for a process that failed to start. On
    stdout JSON objects are events and all other text is 'raw'.
    """
    channel = F.coalesce("channel", F.lit("stdout")) if "channel" in lines.columns else F.lit("stdout")
    parsed = with_json(
        lines.withColumn("_channel", channel), "_json",
        F.when(F.col("_channel") == "stdout", F.col("line")))

    def text(name: str) -> Column:
        return F.try_variant_get("_json", f"$.{name}", "string")

    is_object = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    kinds = (
        F.when(F.col("_channel") == "stderr", "stderr")
        .when(F.col("_channel") == "spawn", "error")
        .when(~is_object, "raw")
        .when(text("loss").isNotNull(), "metric")
    )
    shown = F.when(~is_object, F.col("line"))
    for name in ("error", "warning", "status", "message"):
        kinds = kinds.when(text(name).isNotNull(), name)
        shown = shown.when(text(name).isNotNull(), F.coalesce(
            text("message") if name == "status" else text(name), text(name)))
    return parsed.select(
        "run_id", "seq", kinds.otherwise("raw").alias("kind"),
        *[F.try_variant_get("_json", f"$.{m}", "double").alias(m) for m in METRICS],
        F.try_variant_get("_json", "$.step", "bigint").alias("step"),
        F.when(text("loss").isNull(), shown.otherwise(F.col("line"))).alias("text"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(run_id, channel, line_no, line) of a process's output as (run_id, channel, seq, data), cut anywhere.

    A line may reach over any number of chunks, and a chunk hold any number of lines; what follows
    the last line feed is a line too, unless it is empty. Only the pieces at the borders of chunks
    are shuffled to be put together; a long run is cut along `seq`, which is a whole number. See
    streaming.lines for streams.
    """
    pieces = F.split(F.coalesce("data", F.lit("")), "\n", -1)
    whole = chunks.select(
        "run_id", "channel", "seq", pieces.alias("_pieces"), (F.size(pieces) - 1).cast("bigint").alias("_feeds"))
    keys = ["run_id", "channel"]
    long = long_keys(whole, keys, "seq")
    placed = running(cut(whole, keys, "seq", long), "seq", {"_before": ("sum", "_feeds")}, inclusive=False, long=long)
    numbered = placed.select(
        *keys, "seq", "_feeds", F.coalesce("_before", F.lit(0).cast("bigint")).alias("_before"), F.posexplode("_pieces").alias("_at", "_piece"))
    numbered = numbered.withColumn("line_no", F.col("_before") + F.col("_at") + 1)
    inner = (F.col("_at") > 0) & (F.col("_at") < F.col("_feeds"))
    border = numbered.filter(~inner).groupBy(*keys, "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_at", "_piece"))), lambda p: p["_piece"]), "").alias("line"),
        # A line has ended if a later piece of a chunk follows the last of its own.
        F.bool_or(F.col("_at") < F.col("_feeds")).alias("_ended"))
    lines = numbered.filter(inner).select(*keys, "line_no", F.col("_piece").alias("line")).unionByName(
        border.filter((F.col("line") != "") | F.col("_ended")).drop("_ended"))
    return lines


def parse_messages(messages: DataFrame) -> DataFrame:
    """(run_id, seq, type and the fields of all types) of (run_id, seq, message).

    A message is a JSON object {type, payload}; the fields of a type other than status, train-log
    and file-size are null but for its text. Texts that are no such object are dropped. The result serves the functions
    below: metrics and `kind` as from `parse_log_stream`, status, and file sizes.
    """
    parsed = with_json(messages, "_json", F.col("message"))

    def field(name: str, type_: str) -> Column:
        return F.try_variant_get("_json", f"$.payload.{name}", type_)

    words = ("message", "stderr", "error", "raw")
    return parsed.withColumn("type", F.try_variant_get("_json", "$.type", "string")).filter(
        F.col("type").isNotNull()
    ).select(
        "run_id", "seq", "type",
        *[field(m, "double").alias(m) for m in METRICS], field("step", "bigint").alias("step"),
        F.coalesce(*[field(w, "string") for w in words]).alias("text"),
        field("running", "boolean").alias("running"), field("pid", "int").alias("pid"),
        field("code", "int").alias("code"), field("killed", "boolean").alias("killed"),
        field("file", "string").alias("file"), field("size", "bigint").alias("size"),
        F.timestamp_millis(field("timestamp", "bigint")).alias("ts"))


def log_messages(messages: DataFrame) -> DataFrame:
    """What a log display shows: everything but file sizes."""
    return messages.filter(F.col("type") != "file-size")


def status_messages(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("type") == "status") & F.col("running").isNotNull())


def size_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("type") == "file-size")


def metric_events(events: DataFrame) -> DataFrame:
    """The events that tell metrics; a loss of 0, or none, does not count."""
    loss = F.col("loss")
    return events.filter(loss.isNotNull() & (loss != 0) & ~F.isnan(loss))


def latest_metrics(events: DataFrame) -> DataFrame:
    """The last metrics of every run."""
    return metric_events(events).groupBy("run_id").agg(
        F.max("seq").alias("seq"),
        *[F.max_by(c, "seq").alias(c) for c in (*METRICS, "step")])


def metric_cards(latest: DataFrame) -> DataFrame:
    """The metrics as shown to a user; '-' for one that is missing."""
    shown = {
        "epoch": to_fixed(F.col("epoch"), 2),
        "loss": to_fixed(F.col("loss"), 4),
        "learning_rate": to_exponential(F.col("learning_rate"), 2),
        "grad_norm": to_fixed(F.col("grad_norm"), 2),
    }
    return latest.select("run_id", *[
        F.when(F.col(name).isNull(), "-").otherwise(card).alias(name)
        for name, card in shown.items()])


def recent_logs(events: DataFrame, n: int = fixed.LOG_TAIL) -> DataFrame:
    """The last n events of every run.

    Spark keeps n rows per run in every task before the shuffle.
    """
    newest = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
    return events.withColumn("_age", F.row_number().over(newest)).filter(
        F.col("_age") <= n).drop("_age")


def latest_file_sizes(events: DataFrame, order: str = "ts") -> DataFrame:
    """The last size of every file; of sizes told at the same time the larger one."""
    return events.groupBy("file").agg(F.max_by("size", F.struct(order, "size")).alias("size")).withColumn(
        "size_mb", F.round(F.col("size") / F.lit(fixed.BYTES_PER_MB), 2))


def run_status(events: DataFrame) -> DataFrame:
    """The last status of every run, and whether it was ever killed."""
    return events.groupBy("run_id").agg(
        F.max("seq").alias("seq"),
        *[F.max_by(c, "seq").alias(c) for c in ("running", "pid", "code")],
        F.coalesce(F.max("killed"), F.lit(False)).alias("killed"))


def overlapping_runs(runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Of runs as (run_id, started, ended), those started while an earlier one was active.

    `started` and `ended` are log positions; `ended` is null for a run still active.
    """
    long = long_keys(runs, [], "started", chunk)
    known = runs.select("run_id", "started", "ended").withColumn(
        "_end", F.coalesce("ended", F.lit(2**63 - 1)))
    earlier = running(
        cut(known, [], "started", long), "started", {"active_until": ("max", "_end")},
        inclusive=False, long=long)
    return earlier.filter(F.col("active_until") > F.col("started")).select(
        "run_id", "started", "ended")

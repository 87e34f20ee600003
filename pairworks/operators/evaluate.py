"""Scoring predictions by exact match and by a judge model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import fill, py_strip, strip_fences, with_json
from pairworks.plans.ranking import at_or_before, quota_cuts, with_cuts
from pairworks.plans.running import CHUNK, cut, long_keys

RUN = ("model", "quantization")


def _share(n: Column, limit: Column) -> Column:
    part = F.greatest(F.lit(1), F.floor(n * limit.cast("double")))
    return F.when((limit > 0) & (limit < 1), part).otherwise(n).cast("bigint")


def choose_test_set(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The file to evaluate on, per key: val.jsonl if it is there, or else dataset.jsonl."""
    wanted = files.filter(F.col("name").isin(*fixed.TEST_SETS))
    return wanted.groupBy(*keys).agg(
        F.max_by("path", F.col("name") == fixed.TEST_SETS[0]).alias("path")
    ).filter(F.col("path").isNotNull())


def head_lines(lines: DataFrame, limit: float) -> DataFrame:
    """The first share of every file's raw lines, for the output of `with_line_no`.

    Blank and broken lines count, so this goes before parsing.
    """
    return lines.filter(F.col("line_no") <= _share(F.col("file_lines"), F.lit(float(limit))))


def head_fraction(
    df: DataFrame, limit: float, keys: tuple[str, ...], order: str, chunk: int = CHUNK
) -> DataFrame:
    """The same for a table with a whole-number `order` that does not repeat within a key.

    Only the chunk of rows that the share ends in is sorted; other rows are compared with the row
    found there. Chunks are cut by counted rows, so sparse positions make no difference.
    """
    if not 0 < limit < 1:
        return df
    at = {"at": F.col(order)}
    long = long_keys(df, list(keys), order, chunk)
    narrow = cut(df.select(*dict.fromkeys([*keys, order])), list(keys), order, long)
    cuts = quota_cuts(narrow, list(keys), F.col("_chunk"), at, lambda n: _share(n, F.lit(float(limit))))
    return with_cuts(df, cuts, list(keys)).filter(at_or_before(at)).select(*df.columns)


def finalize_prediction(reply: Column) -> Column:
    """The reply up to its first stop sequence, stripped."""
    for stop in fixed.STOP_SEQUENCES:
        reply = F.substring_index(reply, stop, 1)
    return py_strip(reply)


def score_exact(df: DataFrame) -> DataFrame:
    """Adds `output` and `correct` from `reply`; rows whose call failed have neither.

    A missing target counts as empty, so that an empty prediction is correct.
    """
    output = finalize_prediction(F.col("reply"))
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    return df.withColumn("output", F.when(~failed, output)).withColumn(
        "correct", F.col("output") == F.coalesce(F.col("target"), F.lit("")))


def accuracy_report(
    scored: DataFrame,
    runs: DataFrame | None = None,
    rejects: DataFrame | None = None,
    keys: tuple[str, ...] = RUN,
) -> DataFrame:
    """accuracy, total, correct and skipped per run.

    `runs` lists runs to report even without a scored row; `rejects` holds the lines that could
    not be parsed. A row whose call failed counts nowhere.
    """
    counts = scored.groupBy(*keys).agg(
        F.count("correct").alias("total"), F.count_if("correct").alias("correct"))
    if runs is not None:
        counts = runs.select(*keys).distinct().join(counts, list(keys), "left")
    if rejects is not None:
        skipped = rejects.groupBy(*keys).agg(F.count("*").alias("skipped"))
        counts = counts.join(skipped, list(keys), "left" if runs is not None else "full")
    else:
        counts = counts.withColumn("skipped", F.lit(0).cast("bigint"))
    zero = counts.fillna(0, ["total", "correct", "skipped"])
    accuracy = F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0))
    return zero.select(*keys, accuracy.alias("accuracy"), "total", "correct", "skipped")


def judge_instruction(sharpness: Column) -> Column:
    return (
        F.when(sharpness < fixed.LENIENT_BELOW, fixed.LENIENT)
        .when(sharpness > fixed.STRICT_ABOVE, fixed.STRICT)
        .otherwise(fixed.BALANCED)
    )


def judge_prompts(df: DataFrame) -> DataFrame:
    """Adds `prompt` for (input, target, output, sharpness)."""
    return df.withColumn("prompt", fill(
        fixed.JUDGE_TEMPLATE, instruction=judge_instruction(F.col("sharpness")),
        input=F.col("input"), target=F.col("target"), output=F.col("output")))


def parse_judgments(df: DataFrame) -> DataFrame:
    """Adds score, reason, failed and out_of_range from `reply`.

    A failed call, or a reply without a numeric score, scores 0. Scores are not clamped.
    """
    parsed = with_json(df, "_json", strip_fences(F.col("reply")))
    raw = F.try_variant_get("_json", "$.score", "variant")
    numeric = F.schema_of_variant(raw).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    score = F.when(numeric, F.try_variant_get("_json", "$.score", "double"))
    return (
        parsed.withColumn("score", score)
        .withColumn("failed", F.col("score").isNull())
        .withColumn("reason", F.when(F.col("failed"), fixed.JUDGE_FAILED).otherwise(
            F.try_variant_get("_json", "$.reason", "string")))
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .withColumn("out_of_range", ~F.col("score").between(0, 10))
        .drop("_json")
    )


def judge_report(
    judged: DataFrame, accuracy: DataFrame, keys: tuple[str, ...] = RUN
) -> DataFrame:
    """The mean score per run, failures included as 0, next to the run's accuracy."""
    settings = [c for c in ("sharpness", "limit") if c in judged.columns]
    scores = judged.groupBy(*keys, *settings).agg(F.avg("score").alias("average_score"))
    static = accuracy.select(*keys, F.col("accuracy").alias("static_accuracy"))
    return scores.join(static, list(keys), "left")

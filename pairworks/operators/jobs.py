"""Whole jobs put together from the operators: importing, training input, evaluating, judging."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import generated_file_name, repo_file_name
from pairworks.operators.completion import (
    Client, complete_once, parse_variations, variation_prompts,
)
from pairworks.operators.evaluate import (
    accuracy_report, head_lines, judge_prompts, judge_report, parse_judgments, score_exact,
)
from pairworks.operators.normalize import is_complete, normalize_pairs, transform_rows
from pairworks.operators.prepare import make_batches, prompt, split_pairs, tokenize_and_mask
from pairworks.plans.shared import materialise
from pairworks.sources.lines import parse_pairs
from pairworks.sources.tables import write_pairs_jsonl

# Fixed value: the name that evaluation looks for.
VALIDATION_FILE = "val.jsonl"


def import_dataset(
    raw: DataFrame,
    repo: str,
    folder: str,
    transform: Callable[[dict[str, Any]], dict[str, Any] | None] | None = None,
) -> dict[str, Any]:
    """Writes the complete pairs of a source below `folder`; gives filename, count and skipped.

    The counts are observed during the write, so the source is read once.
    """
    pairs = transform_rows(raw, transform, []) if transform else normalize_pairs(raw, keep=[])
    counts = Observation("import")
    seen = pairs.select("input", "target").observe(
        counts, F.count_if(is_complete()).alias("count"), F.count_if(~is_complete()).alias("skipped"))
    name = repo_file_name(repo)
    write_pairs_jsonl(seen.filter(is_complete()), f"{folder}/{name}", partition=None, rebalance=False)
    return {"filename": name, **counts.get}


def training_input(
    pairs: DataFrame,
    val_split: float,
    batch_size: int,
    tokenizer,
    max_len: int = fixed.DEFAULT_MAX_LEN,
    epoch: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(batches of the training rows, validation rows) of stored pairs."""
    if pairs.isEmpty():
        raise ValueError("Dataset is empty")
    split = split_pairs(pairs, val_split)
    train = tokenize_and_mask(split.filter("split = 'train'"), tokenizer, max_len)
    held_out = split.filter("split = 'validation'").drop("split")
    return make_batches(train, batch_size, tokenizer.eos_id, epoch), held_out


PUBLISHED = "published"


def training_job(
    pairs: DataFrame,
    val_split: float,
    batch_size: int,
    tokenizer,
    folder: str,
    max_len: int = fixed.DEFAULT_MAX_LEN,
    epoch: int = 0,
) -> dict[str, Any]:
    """Writes the batches and val.jsonl of one split below `folder`; gives run, train and validation.

    Both outputs come from one stored split and go into a folder of their own, which counts as soon as
    a row of the table `published` names it. Readers take them from there, see `published_run`: a
    run that breaks off leaves the outputs of the run before in place.
    """
    if pairs.isEmpty():
        raise ValueError("Dataset is empty")
    spark = pairs.sparkSession
    counts = Observation("split")
    counted = split_pairs(materialise(pairs, "pairs"), val_split).observe(
        counts, F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation"))
    split = materialise(counted, "split")
    told = counts.get
    if not told["train"]:
        raise ValueError("Training set is empty")
    run = uuid.uuid4().hex
    train = tokenize_and_mask(split.filter("split = 'train'"), tokenizer, max_len)
    make_batches(train, batch_size, tokenizer.eos_id, epoch).write.parquet(f"{folder}/{run}/batches")
    write_pairs_jsonl(split.filter("split = 'validation'").select("dataset", "input", "target"), f"{folder}/{run}/{VALIDATION_FILE}")
    row = spark.range(0, 1, 1, 1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{folder}/{PUBLISHED}")
    return {"run": run, **told}


def published_run(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """(batches, val.jsonl) of the last run that `training_job` finished below `folder`."""
    try:
        last = spark.read.schema("run string, at timestamp").parquet(f"{folder}/{PUBLISHED}").orderBy(F.desc("at"), "run").first()
    except AnalysisException:
        return None
    return (f"{folder}/{last['run']}/batches", f"{folder}/{last['run']}/{VALIDATION_FILE}") if last else None


def generate_job(
    seeds: DataFrame,
    keys: list[str],
    client_factory: Callable[[], Client],
    folder: str,
    max_count: int | None = fixed.MAX_VARIATIONS,
    made: datetime.datetime | None = None,
    **options,
) -> tuple[dict[str, Any], DataFrame]:
    """Writes the variations of all seeds as one generated dataset; ({filename, count}, rejects).

    The name tells when it was made. With `path` among the options, calls go through the ledger there.
    """
    spark = seeds.sparkSession
    at = made or datetime.datetime.now(datetime.timezone.utc)
    name = spark.range(1).select(generated_file_name(F.lit(at))).first()[0]
    rows, rejects = generate_variations(seeds, keys, client_factory, max_count, **options)
    counts = Observation("generated")
    write_pairs_jsonl(rows.select("input", "target").observe(counts, F.count("*").alias("count")), f"{folder}/{name}",
                      partition=None, rebalance=False)
    return {"filename": name, **counts.get}, rejects


def generate_variations(
    seeds: DataFrame, keys: list[str], client_factory: Callable[[], Client],
    max_count: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejects): the variations of every seed that a model makes."""
    prompts, refused = variation_prompts(seeds, max_count)
    replies = complete_once(
        prompts.select(*keys, "prompt"), keys, "prompt", client_factory,
        temperature=fixed.VARIATION_TEMPERATURE, **options)
    rows, failed = parse_variations(replies, keys)
    return rows, refused.select(*keys, "error_code", "error_message").unionByName(
        failed.select(*keys, "error_code", "error_message"))


def evaluate_model(
    lines: DataFrame,
    model: str,
    quantization: str,
    client_factory: Callable[[], Client],
    limit: float = 1.0,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(report, samples) for a test set as `with_line_no` gives it."""
    run = {"model": F.lit(model), "quantization": F.lit(quantization)}
    rows, rejects = parse_pairs(head_lines(lines, limit))
    asked = rows.select(
        "file", "line_no", "input", "target", "target_missing",
        prompt(F.col("input")).alias("prompt")).withColumns(run)
    replies = complete_once(asked, ["file", "line_no"], "prompt", client_factory, **options)
    scored = score_exact(replies)
    runs = lines.sparkSession.range(1).select(*[c.alias(k) for k, c in run.items()])
    report = accuracy_report(scored, runs, rejects.withColumns(run))
    samples = scored.filter(F.col("error").isNull()).select(
        *run, "file", "line_no", "input", "target", "target_missing", "output", "correct")
    return report, samples


def judge_model(
    samples: DataFrame,
    report: DataFrame,
    client_factory: Callable[[], Client],
    limit: float = fixed.DEFAULT_JUDGE_LIMIT,
    sharpness: int = fixed.DEFAULT_SHARPNESS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(report, judged samples) for what `evaluate_model` gives under the same limit."""
    if samples.isEmpty():
        raise ValueError("No samples found in static report")
    asked = judge_prompts(samples.withColumns({
        "sharpness": F.lit(sharpness), "limit": F.lit(float(limit))}))
    replies = complete_once(
        asked, ["model", "quantization", "file", "line_no"], "prompt", client_factory,
        temperature=fixed.JUDGE_TEMPERATURE, **options)
    judged = parse_judgments(replies)
    return judge_report(judged, report), judged

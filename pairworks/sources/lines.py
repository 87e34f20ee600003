"""Line-oriented JSON files: line numbers, and training pairs read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairworks.functions.text import py_strip, unescape, with_json, with_json_texts
from pairworks.plans.shared import materialise

INVALID_JSON = "INVALID_JSON"
SPLITS_TO_BROADCAST = 1_000_000


def with_line_no(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as (file, line_no, file_lines, value); line_no starts at 1.

    Files are read in splits. Each row takes an id at the scan that counts up within its split,
    and the lines of the splits before give a row its number. Splits depend on the cores at hand,
    which may change between two scans, so that one scan is stored and both the counts and the
    lines come from it. No line is shuffled. The split table has one row per split.
    """
    lines = materialise(spark.read.text(path).select(
        unescape(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    ), "lines")
    blocks = lines.groupBy("file", "_block").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        blocks
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("file_lines", F.sum("_rows").over(of_file))
        .drop("_rows"),
        "splits", SPLITS_TO_BROADCAST,
    )
    number = (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no")
    return lines.join(offsets, ["file", "_block"]).select("file", number, "file_lines", "value")


def across_files(numbered: DataFrame, group: str) -> DataFrame:
    """Lines as from `with_line_no`, numbered over all files of a group, in the order of the files' names.

    For tables that are written in order by many tasks; `file_lines` then is the number of a group's
    lines. No line is shuffled: the table of files has one row per file.
    """
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = materialise(
        numbered.select(group, "file", "file_lines").distinct().select(
            "file", F.coalesce(F.sum("file_lines").over(before), F.lit(0)).alias("_before"),
            F.sum("file_lines").over(of_group).alias("_lines")),
        "files", SPLITS_TO_BROADCAST)
    return numbered.join(files, "file").withColumns({
        "line_no": F.col("_before") + F.col("line_no"), "file_lines": F.col("_lines")}).drop("_before", "_lines")


def parse_pairs(
    lines: DataFrame, extra: dict[str, str] | None = None, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a frame with a JSON text column `value`.

    Blank lines are dropped. Lines that are not a JSON object go to `rejects`; with `strict` the
    first of them fails the job. A missing or null input or target becomes the empty text, and
    `target_missing` tells it from one that was empty. `extra` names further fields to keep,
    with their types.
    """
    others = [c for c in lines.columns if c != "value"]
    parsed = with_json(
        lines.filter(py_strip(F.col("value")) != ""), "_json", F.col("value"), oversized=True)
    # Objects beyond a VARIANT have their fields as texts.
    parsed = with_json_texts(
        parsed, "_texts", F.col("_json"), F.col("value"), list(dict.fromkeys(["input", "target", *(extra or {})])))
    is_object = F.coalesce(
        F.schema_of_variant("_json").startswith("OBJECT"), F.col("_texts").isNotNull())
    field = _field_reader("_json", "_texts")
    if strict:
        message = F.concat(F.lit("not a JSON object: "), F.col("value"))
        parsed = parsed.filter(F.when(is_object, F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean")))
    rows = parsed.filter(is_object).select(
        *others,
        F.coalesce(field("input"), F.lit("")).alias("input"),
        F.coalesce(field("target"), F.lit("")).alias("target"),
        field("target").isNull().alias("target_missing"),
        *[field(name, type_).alias(name) for name, type_ in (extra or {}).items()],
    )
    rejects = parsed.filter(~is_object).select(
        *others, "value", F.lit(INVALID_JSON).alias("error_code"),
        F.lit("line is not a JSON object").alias("error_message"))
    return rows, rejects


def read_pairs_jsonl(
    spark: SparkSession,
    path: str | list[str],
    extra: dict[str, str] | None = None,
    strict: bool = False,
    numbered: bool = False,
    identified: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSONL files, with `file` and, if `numbered`, line_no and file_lines.

    With `identified`, files of plain {input, target} lines get what later steps need: `dataset`
    is the file, and `sample_id` the number of the line.
    """
    if numbered or identified:
        lines = with_line_no(spark, path)
        if identified:
            lines = lines.withColumns({"dataset": F.col("file"), "sample_id": F.col("line_no").cast("bigint")})
    else:
        lines = spark.read.text(path).select(unescape(F.col("_metadata.file_path")).alias("file"), "value")
    return parse_pairs(lines, extra, strict)


def _field_reader(variant: str, texts: str):
    def read(name: str, type_: str = "string") -> Column:
        return F.coalesce(F.try_variant_get(F.col(variant), f"$.{name}", type_), F.col(texts)[name].try_cast(type_))
    return read

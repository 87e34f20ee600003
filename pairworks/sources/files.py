"""File listings: the upload gate and inventories. File contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import safe_file_name, unescape
from pairworks.sources.folders import list_folders


def list_files(spark: SparkSession, roots: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, name, size, modified) of the files below some folders, listed by tasks."""
    return list_folders(spark, roots, glob)


def gate_files(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a listing with `name` and `size`.

    Names must end in .jsonl; files above `max_bytes`, if given, are too large. Accepted files get the name they
    are stored under, and `collides` where several share it and would overwrite each other.
    """
    no_name = F.coalesce(F.col("name"), F.lit("")) == ""
    wrong_type = ~F.col("name").endswith(fixed.PAIR_FILE_SUFFIX)
    too_big = F.col("size") > max_bytes if max_bytes is not None else F.lit(False)
    message = (
        F.when(no_name, "No file uploaded")
        .when(wrong_type, "Only .jsonl files are allowed")
        .when(too_big, "File too large")
    )
    checked = files.withColumn("error_message", message)
    rejected = checked.filter(F.col("error_message").isNotNull()).withColumn(
        "error_code", F.lit("INVALID_INPUT"))
    named = checked.filter(F.col("error_message").isNull()).drop("error_message").withColumn(
        "safe_name", safe_file_name(F.col("name")))
    shared = named.groupBy("safe_name").agg(F.count("*").alias("_files")).filter("_files > 1")
    accepted = named.join(shared, "safe_name", "left").withColumn(
        "collides", F.col("_files").isNotNull()).drop("_files")
    return accepted, rejected


def dataset_inventory(files: DataFrame, selected: str | None = None) -> DataFrame:
    """Pair files with `selected` set on the one that the configured path ends in."""
    chosen = selected.rsplit("/", 1)[-1] if selected else ""
    return files.filter(F.col("name").endswith(fixed.PAIR_FILE_SUFFIX)).select(
        F.lit("dataset").alias("kind"), "name", "size", F.col("modified").alias("created"),
        (F.col("name") == F.lit(chosen)).alias("selected"), F.lit(None).cast("string").alias("url"))


def folder_inventory(files: DataFrame, selected: str | None = None) -> DataFrame:
    """The same for datasets written by `write_pairs_jsonl`: one row per `dataset=` folder."""
    folder = unescape(F.regexp_extract("path", r"/dataset=([^/]+)/", 1))
    return files.withColumn("name", folder).filter(F.col("name") != "").groupBy("name").agg(
        F.sum("size").alias("size"), F.min("modified").alias("created"),
    ).select(
        F.lit("dataset").alias("kind"), "name", "size", "created",
        (F.col("name") == F.lit(selected or "")).alias("selected"),
        F.lit(None).cast("string").alias("url"))


def artifact_inventory(files: DataFrame) -> DataFrame:
    """Model files and reports with the address they are served under."""
    wanted = F.lit(False)
    for suffix in fixed.ARTIFACT_SUFFIXES:
        wanted = wanted | F.col("name").endswith(suffix)
    return files.filter(wanted).select(
        F.lit("artifact").alias("kind"), "name", "size", F.col("modified").alias("created"),
        F.lit(None).cast("boolean").alias("selected"),
        F.concat(F.lit(fixed.ARTIFACT_URL_PREFIX), F.col("name")).alias("url"))


def file_inventory(
    spark: SparkSession, data_roots: list[str], model_roots: list[str], selected: str | None = None
) -> DataFrame:
    datasets = dataset_inventory(list_files(spark, data_roots, "*.jsonl"), selected)
    artifacts = artifact_inventory(list_files(spark, model_roots, "*.{gguf,json}"))
    return datasets.unionByName(artifacts)

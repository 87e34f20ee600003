"""First-row inspection of a source, and sinks for pairs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.functions.text import unescape
from pairworks.plans.running import group_key
from pairworks.plans.shared import materialise

def inspect(df: DataFrame) -> DataFrame:
    """One row: the column names, and the first row as JSON. Reads no further than that row."""
    return df.limit(1).select(
        F.array(*[F.lit(c) for c in df.columns]).alias("schema"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("sample"))


def inspect_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The same per key: its first row by `order`, which must not repeat within a key.

    Finds the position of each first row before reading whole rows.
    """
    firsts = materialise(df.groupBy(*keys).agg(F.min(order).alias("_first")), "first-rows").select(
        group_key(keys).alias("_g"), "_first")
    rows = df.withColumn("_g", group_key(keys)).join(
        firsts, ["_g"]).filter(F.col(order) == F.col("_first"))
    return rows.select(
        *keys,
        F.array(*[F.lit(c) for c in df.columns]).alias("schema"),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("sample"))


def write_pairs_jsonl(
    df: DataFrame, path: str, partition: str | None = "dataset", rebalance: bool = True,
    order: str | None = None,
) -> None:
    """One JSON object per line, one folder per dataset; only datasets in `df` are replaced.

    Rebalancing gathers the rows of small datasets, so that not every task writes a file for
    every dataset, and splits large datasets over many tasks and files. With `order` the lines of
    a dataset rise by it, from file to file by name, and large datasets are split by its ranges.
    """
    if order:
        sorting = [partition, order] if partition else [order]
        df = df.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    elif rebalance:
        df = df.hint("rebalance", partition) if partition else df.hint("rebalance")
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def write_report(summary: DataFrame, samples: DataFrame, path: str) -> None:
    """An evaluation or judge report: summary and samples as Parquet, the summary also as JSON."""
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    summary.sparkSession.read.parquet(f"{path}/summary").write.mode("overwrite").json(
        f"{path}/summary-json")


def dataset_name(file: Column) -> Column:
    """The `dataset=` folder a line was read from, or else the file's name without its suffix."""
    folder = F.regexp_extract(file, r"/dataset=([^/]+)/", 1)
    name = F.regexp_replace(F.substring_index(file, "/", -1), r"\.jsonl?$", "")
    return F.when(folder != "", unescape(folder)).otherwise(name)

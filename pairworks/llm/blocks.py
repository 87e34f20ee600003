"""Vectors in pairs of blocks: a stated set of queries against all rows, block by block.

Rows are dealt by hash into candidate blocks, queries into query blocks, and each pair of blocks
is one small group. What a task holds is bounded by the two block sizes, whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairworks.llm.common import materialise

CANDIDATES = 4096
QUERIES = 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """(vec_id, v) of rows that take part: an id, and a vector of finite numbers of the usual length.

    The usual length is that of most vectors, the smaller one of equally many. With zero=False,
    vectors of zeros take no part.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if not zero:
        rows = rows.filter(F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.filter(F.size("v") == (usual.n if usual else 0))


def in_blocks(rows: DataFrame, is_query: Column, kernel: Callable[[dict, dict], dict], schema: str, extra: tuple[str, ...] = (),
              candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """`kernel` on each pair of a candidate block and a query block of stored `rows` (vec_id, v, extra).

    It gets two dictionaries of numpy arrays (v as a matrix) and returns the columns of `schema`.
    """
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_blocks, q_blocks = max(1, math.ceil(counts.n / candidates)), max(1, math.ceil(counts.q / queries))
    columns = ["vec_id", "v", *extra]
    hashed = F.xxhash64("vec_id")
    left = rows.select(*columns, F.pmod(hashed, F.lit(n_blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("query_block"))
    right = rows.filter(is_query).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"),
                                         F.pmod(hashed, F.lit(q_blocks)).cast("int").alias("query_block"))
    names = [part.split()[0] for part in schema.split(",")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kinds = pa.schema([(part.split()[0], arrow[part.split()[1]]) for part in schema.split(",")])

    def arrays(table: pa.Table) -> dict:
        table = table.combine_chunks()
        out = {"n": table.num_rows}
        for name in columns:
            column = table.column(name).combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
            if pa.types.is_list(column.type):
                out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            elif pa.types.is_binary(column.type):
                out[name] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(table.num_rows, -1)
            else:
                out[name] = column.to_numpy(zero_copy_only=False)
        return out

    def run(block: pa.Table, query_block: pa.Table) -> pa.Table:
        if not block.num_rows or not query_block.num_rows:
            return kinds.empty_table()
        result = kernel(arrays(block), arrays(query_block))
        return pa.table([pa.array(result[name], kinds.field(name).type) for name in names], schema=kinds)

    keys = ["block", "query_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: highest score first, ties to the smaller vec_id; rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def store(rows: DataFrame, label: str) -> DataFrame:
    return materialise(rows, label)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]

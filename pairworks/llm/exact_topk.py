"""Exact top-k by columnar branch and bound.

Candidates lie dimension by dimension. A query adds up its products block of dimensions by block,
its own heaviest blocks first. What the blocks still to come can add is at most the product of
the two remaining lengths; candidates that cannot reach the k-th best any more are dropped and
the rest moved together before the next block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from pairworks.llm.blocks import best, in_blocks, store, top, usable

DIMENSIONS = 8  # in a block
_EXACT = float(1 << 53)


def _search(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, columns: np.ndarray,
            masses: np.ndarray) -> np.ndarray:
    """Places of the k best of all but the query itself. `columns` are the vectors by dimension,
    `masses` the squared length of each vector in each block of dimensions."""
    n_blocks = len(masses)
    own = np.array([float(query[b * DIMENSIONS:(b + 1) * DIMENSIONS] @ query[b * DIMENSIONS:(b + 1) * DIMENSIONS])
                    for b in range(n_blocks)])
    order = np.argsort(-own, kind="stable")
    alive = np.flatnonzero(ids != query_id)
    partial = np.zeros(len(alive))
    rest = masses[:, alive].sum(axis=0)
    for step, b in enumerate(order):
        dims = slice(b * DIMENSIONS, (b + 1) * DIMENSIONS)
        partial = partial + query[dims] @ columns[dims, :][:, alive] if len(alive) < len(ids) // 2 else \
            partial + (query[dims] @ columns[dims, :])[alive]
        rest = np.maximum(rest - masses[b, alive], 0)
        own_rest = own[order[step + 1:]].sum()
        if own_rest <= 0 or len(alive) <= k:
            continue
        # A little more than the bound, for the rounding of the root.
        reach = np.sqrt(own_rest * rest) * (1 + 1e-9) + 1e-6
        lower = partial - reach
        least = np.partition(lower, len(lower) - k)[len(lower) - k]
        keep = partial + reach >= least
        if keep.sum() < 0.9 * len(keep):
            alive, partial, rest = alive[keep], partial[keep], rest[keep]
    return alive[top(partial, ids[alive], k)]


def search_blocks(k: int):
    """The kernel for pairs of blocks: the k best of each query in a block of candidates, scores exact."""

    def kernel(block: dict, queries: dict) -> dict:
        vectors, wanted = block["v"], queries["v"]
        n, d = vectors.shape
        largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * d
        fits = max(largest, float(np.abs(vectors).max(initial=0)) ** 2 * d, float(np.abs(wanted).max(initial=0)) ** 2 * d) < _EXACT
        columns = np.ascontiguousarray(vectors.T)
        starts = np.arange(0, d, DIMENSIONS)
        masses = np.add.reduceat(columns ** 2, starts, axis=0) if fits else None
        out = {"query_id": [], "vec_id": [], "score": []}
        for query, query_id in zip(wanted, queries["vec_id"], strict=True):
            if fits:
                at = _search(vectors, block["vec_id"], query, query_id, k, columns, masses)
                scores = (vectors[at] @ query).astype(np.int64)
            else:
                # Products beyond 53 bits: whole numbers of any size.
                whole = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in vectors]
                other = [i for i in range(n) if block["vec_id"][i] != query_id]
                at = sorted(other, key=lambda i: (-whole[i], block["vec_id"][i]))[:k]
                scores = [min(max(whole[i], -(1 << 63)), (1 << 63) - 1) for i in at]
            out["query_id"] += [query_id] * len(at)
            out["vec_id"] += list(block["vec_id"][at])
            out["score"] += list(scores)
        return out

    return kernel


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x), ties to smaller ids.

    `is_query` is a condition on vec_id. Candidates of a query are all rows with another id; each
    row of a repeated id counts. Rows without an id, vectors that are null, empty, of an unusual
    length or hold null or non-finite numbers take no part. Fewer candidates give fewer rows, an
    empty table none; other columns are not read. Scores beyond 64 bits stop at their ends.
    """
    stored = store(usable(vectors, id_col, vector_col), "topk-vectors")
    search = search_blocks(k)

    def kernel(block: dict, queries: dict) -> dict:
        return search({**block, "v": np.floor(block["v"] * scale)}, {**queries, "v": np.floor(queries["v"] * scale)})

    return best(in_blocks(stored, is_query, kernel, "query_id long, vec_id long, score long"), k)

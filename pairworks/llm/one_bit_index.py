"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, rotated at random and kept as the signs of their components, eight to a
byte, with two numbers: the length, and the product of the unit vector with its code. A query
looks up each byte of a code in a table of its own; that sum and the two numbers estimate the
inner product, and an error bound says how far off it may be. Only vectors whose upper end
reaches the k-th best lower end are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.llm.blocks import best, in_blocks, store, top, usable
from pairworks.llm.common import map_batches

SEED = 20
ERRORS = 2.5  # half-width of the bound, in standard errors of the estimate


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    matrix, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return matrix * np.sign(np.diag(upper))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The index, a row for every usable vector: vec_id, v, code, length, fit; and the centre.

    The centre is the mean of all vectors, summed per batch first. `fit` is the product of the
    centred unit vector with its code; a vector at the centre has length 0 and fit 1.
    """
    rows = usable(vectors, id_col, vector_col, zero=False)

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total),
                                           pa.array([batch.num_rows] * len(total), pa.int64())], ["i", "s", "n"])

    means = map_batches(rows.select("v"), sums, "i int, s double, n long", rows=10_000).groupBy("i").agg(
        (F.sum("s") / F.sum("n")).alias("mean")).orderBy("i").collect()
    centre = np.array([row.mean for row in means])
    matrix = rotation(len(centre), seed) if len(centre) else np.zeros((0, 0))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        turned = (batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) - centre) @ matrix
        lengths = np.linalg.norm(turned, axis=1)
        fits = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]) / np.where(lengths > 0, lengths, 1)
        codes = np.packbits(turned > 0, axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lengths),
             pa.array(np.where(lengths > 0, fits, 1.0))], ["vec_id", "v", "code", "length", "fit"])

    index = map_batches(rows, encode, "vec_id long, v array<double>, code binary, length double, fit double", rows=4096)
    return store(index, "one-bit-index"), centre


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)


def _estimates(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The product of the rotated query with each code of components +-1, by a table per byte."""
    padded = np.zeros(codes.shape[1] * 8)
    padded[:len(query)] = query
    tables = _BITS @ padded.reshape(-1, 8).T  # a row per byte value, a column per byte of a code
    total = np.zeros(len(codes))
    for j in range(codes.shape[1]):
        total += tables[codes[:, j], j]
    return (2 * total - query.sum()) / np.sqrt(len(query))


def search(index: DataFrame, centre: np.ndarray, is_query: Column, k: int = 20, errors: float = ERRORS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product, scores exact in double precision."""
    matrix = rotation(len(centre), seed) if len(centre) else np.zeros((0, 0))

    def kernel(block: dict, queries: dict) -> dict:
        out = {"query_id": [], "vec_id": [], "score": []}
        vectors, ids, lengths, fits = block["v"], block["vec_id"], block["length"], block["fit"]
        spread = np.sqrt(np.maximum(1 - fits ** 2, 0)) / fits / np.sqrt(max(vectors.shape[1] - 1, 1))
        for query, query_id in zip(queries["v"], queries["vec_id"], strict=True):
            other = ids != query_id
            if not other.any():
                continue
            guess = lengths * _estimates(block["code"], query @ matrix) / fits + centre @ query
            error = errors * lengths * spread * np.linalg.norm(query)
            low = np.where(other, guess - error, -np.inf)
            m = min(k, int(other.sum()))
            least = np.partition(low, len(low) - m)[len(low) - m]
            near = np.flatnonzero(other & (guess + error >= least))
            exact = vectors[near] @ query
            at = top(exact, ids[near], k)
            out["query_id"] += [query_id] * len(at)
            out["vec_id"] += list(ids[near[at]])
            out["score"] += list(exact[at])
        return out

    found = in_blocks(index, is_query, kernel, "query_id long, vec_id long, score double", ("code", "length", "fit"))
    return best(found, k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, errors: float = ERRORS, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """Indexes every vector and searches with the rows that `is_query`, a condition on vec_id, picks.

    Candidates are all rows with another id; each row of a repeated id counts. Rows without an
    id and vectors that are null, empty, zero, of an unusual length or hold null or non-finite
    numbers take no part. Fewer candidates give fewer rows, an empty table none; other columns
    are not read.
    """
    index, centre = build(vectors, id_col, vector_col)
    return search(index, centre, is_query, k, errors)

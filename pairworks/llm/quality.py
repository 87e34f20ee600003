"""Regularised quadratic discriminant over transformed statistics of documents.

Each class has a mean and a covariance that is shrunk towards the pooled covariance and that
towards its diagonal. A document's score is the logistic of the difference of the two Gaussian
log densities and of the log priors; Mahalanobis distances come from the inverses of the
Cholesky factors, which are worked out once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.llm.common import map_batches, materialise

# Kinds of bytes; every other byte is of the last kind.
_KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|",
    "symbol": b"#$%&'()*+-/<=>@[\\]^_`{}~\"", "lead": bytes(range(0xC0, 0x100)), "tail": bytes(range(0x80, 0xC0)),
    "control": bytes([*range(9), *range(14, 32), 127])}
_NAMES = list(_KINDS)
_KIND_OF = np.full(256, len(_NAMES) - 1, np.int64)
for _i, _kind in enumerate(_NAMES):
    _KIND_OF[list(_KINDS[_kind])] = _i

FEATURES = ["log_length", "upper", "digit", "line", "stop", "comma", "shout", "bar", "symbol", "accent", "control",
            "twice", "word_length", "long_word", "words_repeated", "lines_repeated", "capitals", "mixed"]


def statistics(texts: list[str]) -> np.ndarray:
    """A row per text and a column per name in FEATURES; an empty text has statistics like any other."""
    parts = [text.encode("utf-8", "surrogatepass") for text in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts)), lengths)
    kind, n = _KIND_OF[data], len(_NAMES)
    counts = np.bincount(owner * n + kind, minlength=len(parts) * n).reshape(-1, n).astype(float)
    of = {name: counts[:, i] for i, name in enumerate(_NAMES)}
    same = np.r_[False, (data[1:] == data[:-1]) & (owner[1:] == owner[:-1])] if len(data) else np.zeros(0, bool)
    marks = np.isin(kind, [_NAMES.index(k) for k in ("stop", "comma", "shout", "bar", "symbol")])
    twice = np.bincount(owner, same & marks, len(parts))
    upper = kind == _NAMES.index("upper")
    capitals = np.bincount(owner, upper & np.r_[False, upper[:-1]] if len(data) else upper, len(parts))
    words = [part.split() for part in parts]
    n_words = np.fromiter(map(len, words), float, len(parts))
    longest = np.fromiter((max(map(len, w), default=0) for w in words), float, len(parts))
    distinct = np.fromiter((len(set(w)) for w in words), float, len(parts))
    lines = [[x for x in part.split(b"\n") if x] for part in parts]
    n_lines = np.fromiter(map(len, lines), float, len(parts))
    distinct_lines = np.fromiter((len(set(x)) for x in lines), float, len(parts))
    letters = of["lower"] + of["upper"] + of["lead"]
    chars = np.maximum(lengths - of["tail"], 1)
    share = lambda x: np.sqrt(x / chars)
    per_word = lambda x: np.log1p(x) - np.log1p(n_words)
    upper_share = of["upper"] / np.maximum(letters, 1)
    return np.column_stack([
        np.log1p(lengths), share(of["upper"]), share(of["digit"]), share(of["line"]), share(of["stop"]),
        share(of["comma"]), share(of["shout"]), share(of["bar"]), share(of["symbol"]), share(of["lead"]),
        share(of["control"]), np.log1p(twice), np.log((letters + 1) / (n_words + 1)), np.log1p(longest),
        per_word(distinct), np.log1p(distinct_lines) - np.log1p(n_lines), np.log1p(capitals),
        np.sqrt(upper_share * (1 - upper_share))])


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the statistics of each whole text, one row per row. A null text is an empty one."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, stats array<double>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = statistics([text or "" for text in batch.column(1).to_pylist()])
        stats = pa.ListArray.from_arrays(np.arange(len(table) + 1, dtype="i4") * table.shape[1], table.ravel())
        return pa.RecordBatch.from_arrays([batch.column(0), stats], [id_col, "stats"])

    return map_batches(df.select(F.col(id_col), F.col(text_col)), run, schema)


@dataclass
class Discriminant:
    """Two Gaussians, class 0 first, with their priors."""

    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        log_density = []
        for mean, inverse, log_det, prior in zip(self.means, self.inverse_factors, self.log_dets, self.log_priors, strict=True):
            distance = (((rows - mean) @ inverse.T) ** 2).sum(axis=1)
            log_density.append(prior - 0.5 * (distance + log_det))
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def fit(labelled: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.05, floor: float = 1e-3) -> Discriminant:
    """The discriminant of rows with `stats` and `label` (0 or 1; rows with another or null label are left out).

    Counts, sums and sums of products per class are added up in the tasks, and only these few
    numbers reach the driver. A class without rows takes the pooled mean; without any rows every
    score is one half. `to_pooled` and `to_diagonal` are the shares of shrinkage, `floor` is
    added to each variance.
    """
    p = len(FEATURES)
    rows = labelled.filter("label IN (0, 1) AND stats IS NOT NULL")
    sums: list[Column] = [F.count("*")]
    sums += [F.sum(F.col("stats")[i]) for i in range(p)]
    sums += [F.sum(F.col("stats")[i] * F.col("stats")[j]) for i in range(p) for j in range(i, p)]
    found = {row[0]: np.array(row[1:], float) for row in rows.groupBy("label").agg(*sums).collect()}
    n, total, products = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for k, numbers in found.items():
        n[k], total[k] = numbers[0], numbers[1:p + 1]
        products[k][np.triu_indices(p)] = numbers[p + 1:]
        products[k] = np.triu(products[k]) + np.triu(products[k], 1).T
    pooled_mean = total.sum(0) / max(n.sum(), 1)
    means = np.array([total[k] / n[k] if n[k] else pooled_mean for k in (0, 1)])
    scatter = np.array([products[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = scatter.sum(0) / max(n.sum() - 2, 1)
    inverse, log_dets = [], []
    for k in (0, 1):
        cov = scatter[k] / max(n[k] - 1, 1)
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + floor * np.eye(p)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.solve(factor, np.eye(p)))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    priors = np.log((n + 1) / (n.sum() + 2))
    return Discriminant(means, np.array(inverse), np.array(log_dets), priors)


def score(stats: DataFrame, model: Discriminant, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id, score (0 to 1) and predicted (1 from `threshold` on) of rows made by `features`."""
    schema = f"{id_col} {stats.schema[id_col].dataType.simpleString()}, score double, predicted int"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
        scores = model.scores(rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype("i4"))],
            [id_col, "score", "predicted"])

    return map_batches(stats.select(id_col, "stats"), run, schema, rows=10_000)


def fit_and_score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Scores every document by a model learnt from the labelled ones that are not held out.

    `held_out` is a condition on the id. Returns id, held_out, score, predicted, one row per row
    of `docs`. The statistics are worked out once and stored, so that texts are read once. Only
    the statistics enter a score. A null text counts as empty; a row with a null id is scored and
    held out; repeated ids are scored each, and a label that is repeated counts as often as it
    is there; other columns are not read; without labels every score is one half, and an empty
    table gives an empty one.
    """
    stats = materialise(features(docs, id_col, text_col), "quality-stats")
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    training = stats.filter(~F.coalesce(held_out, F.lit(True))).join(known, id_col)
    model = fit(training)
    return score(stats, model, id_col, threshold).select(
        id_col, F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", "predicted")

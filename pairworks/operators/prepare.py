"""Pairs to training input: split, prompt, tokens, labels, batches, plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import fill
from pairworks.plans.ranking import (
    BLOCK_ROWS, at_or_before, fine_bucket, global_rank, in_broken_tie, quota_cuts, shuffle_key, with_cuts,
)

Encoder = Callable[[Sequence[str]], list[list[int]]]
CHARS_AT_ONCE = 1_000_000


def validation_quota(val_split: float) -> Callable[[Column], Column]:
    """At least one row, unless that would leave nothing to train on."""
    def quota(n: Column) -> Column:
        wanted = F.greatest(F.lit(1), F.floor(n * F.lit(float(val_split))))
        return F.when(wanted >= n, 0).otherwise(wanted)
    return quota


def split_pairs(
    df: DataFrame,
    val_split: float,
    seed: int = fixed.SPLIT_SEED,
    keys: tuple[str, ...] = ("dataset",),
    row_id: str = "sample_id",
) -> DataFrame:
    """Adds `split`: an exact, repeatable random share of every dataset is 'validation'.

    Reads only keys and ids to find where each dataset's share ends in hash order; the wide rows
    are then compared with that cut and stay in place. Where ids repeat, the share may end among
    rows with one id: only those are then told apart by their digests, and rows that are equal
    throughout are dealt out by their number. `df` is read three times, so pass a stored table.
    """
    order = {"key": shuffle_key(seed, row_id), "id": F.col(row_id)}
    cuts = quota_cuts(
        df, list(keys), fine_bucket(order["key"]), order, validation_quota(val_split))
    placed = with_cuts(df, cuts, list(keys))
    named = _named(placed, at_or_before(order)).select(*df.columns, "split")
    if cuts.filter("tie_rows > tie_take").isEmpty():
        return named
    tie = in_broken_tie(order)
    sure = _named(placed.filter(~tie), at_or_before(order)).select(*df.columns, "split")
    tied = placed.filter(tie).select(*df.columns, F.col("tie_take").alias("_take"))
    return sure.unionByName(_split_tied(tied, df.columns, [*keys, "_take"]))


def _named(rows: DataFrame, held: Column) -> DataFrame:
    return rows.withColumn("split", F.when(held, "validation").otherwise("train"))


def _split_tied(tied: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """The split of rows of which the first `_take` of every key, by the digests of whole rows, are held out."""
    order = {"digest": F.md5(F.to_json(F.struct(*columns)))}
    cuts = quota_cuts(tied, keys, fine_bucket(order["digest"]), order, lambda n: F.col("_take"))
    placed = with_cuts(tied, cuts, keys)
    equal = in_broken_tie(order)
    sure = _named(placed.filter(~equal), at_or_before(order)).select(*columns, "split")
    one = placed.filter(equal).groupBy(*keys, "tie_rows", "tie_take").agg(F.first(F.struct(*columns)).alias("_row"))
    dealt = one.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("tie_rows"))))
    return sure.unionByName(_named(dealt, F.col("_no") <= F.col("tie_take")).select("_row.*", "split"))


def prompt(source: Column) -> Column:
    return fill(fixed.PROMPT_TEMPLATE, input=source)


def render_prompt(df: DataFrame, eos: str) -> DataFrame:
    """Adds `prompt` and `text`, the prompt followed by the target and the end token."""
    asked = prompt(F.col("input"))
    return df.withColumn("prompt", asked).withColumn(
        "text", F.concat(asked, F.lit(" "), F.col("target"), F.lit(eos)))


class WhitespaceTokenizer:
    """Words between blanks, numbered by their MD5; the end token is 0. Runs in the JVM."""

    eos_id = 0

    def __init__(self, vocabulary: int = 50_000):
        self.vocabulary = vocabulary

    def words(self, text: Column, limit: int) -> Column:
        """The first `limit` words. Two pieces more, for a blank start and for all that follows."""
        pieces = F.split(text, "[ \t\n\r]+", limit + 2)
        return F.slice(F.filter(pieces, lambda word: word != ""), 1, limit)

    def number(self, word: Column) -> Column:
        value = F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("bigint")
        return (value % F.lit(self.vocabulary - 1) + 1).cast("int")

    def encode(self, text: Column, limit: int) -> Column:
        return F.transform(self.words(text, limit), self.number)

    def encode_pair(self, asked: Column, answered: Column, limit: int) -> Column:
        """ids of `answered` and the end token, at most `limit`, and how many ids `asked` has up to `limit`."""
        closed = F.concat(self.encode(answered, limit), F.array(F.lit(self.eos_id)))
        return F.struct(F.slice(closed, 1, limit).alias("ids"), F.size(self.encode(asked, limit)).alias("asked"))


class LoadedTokenizer:
    """A tokenizer that `load` returns, loaded once per Python worker.

    `load()` gives a function from texts to id lists; `eos` is the end token's text. Both texts of
    a row go to Python together, and ids beyond the limit do not come back. A call gets texts of up to
    CHARS_AT_ONCE characters, or one text: the ids of whole texts take many times their size.
    """

    def __init__(self, load: Callable[[], Encoder], eos: str, eos_id: int):
        self.load, self.eos, self.eos_id = load, eos, eos_id

    def encode_pair(self, asked: Column, answered: Column, limit: int) -> Column:
        load = self.load

        @F.pandas_udf("ids array<int>, asked int")
        def pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            encode = load()
            for prompts, texts in batches:
                for rows in _slices([len(p or "") + len(t or "") for p, t in zip(prompts, texts, strict=True)], CHARS_AT_ONCE):
                    ids = [np.array(found[:limit], np.int32) for found in encode(texts[rows].tolist())]
                    lengths = [min(len(found), limit) for found in encode(prompts[rows].tolist())]
                    yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "asked": pd.Series(lengths, dtype="int32")})

        return pairs(asked, F.concat(answered, F.lit(self.eos)))


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    """The rows in their order, cut so that the sizes of a slice with several rows add up to `most` at most.

    No rows make one empty slice.
    """
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield slice(start, at)
            start, total = at, 0
        total += size
    yield slice(start, len(sizes))


def tokenize_and_mask(
    df: DataFrame, tokenizer=None, max_len: int = fixed.DEFAULT_MAX_LEN
) -> DataFrame:
    """Adds input_ids and labels, cut at `max_len`; labels hide the prompt from the loss.

    Where the prompt alone fills the row, every label is hidden and the row is `dead`;
    `truncated` tells whether anything was cut off.
    """
    tokenizer = tokenizer or WhitespaceTokenizer()
    asked = prompt(F.col("input"))
    answered = F.concat(asked, F.lit(" "), F.col("target"))
    ids, shown = F.col("input_ids"), F.least(F.col("_pair.asked"), F.lit(max_len))
    return (
        df.withColumn("_pair", tokenizer.encode_pair(asked, answered, max_len + 1))
        .withColumns({
            "input_ids": F.slice("_pair.ids", 1, max_len), "truncated": F.size("_pair.ids") > max_len})
        .withColumns({
            "labels": F.transform(
                ids, lambda x, i: F.when(i < shown, fixed.IGNORED_LABEL).otherwise(x)),
            "n_tokens": F.size(ids),
            "n_trainable": F.greatest(F.size(ids) - shown, F.lit(0)),
        })
        .withColumn("dead", F.col("n_trainable") == 0)
        .drop("_pair")
    )


def make_batches(
    df: DataFrame,
    batch_size: int,
    pad_id: int,
    epoch: int = 0,
    seed: int = fixed.SPLIT_SEED,
    keys: tuple[str, ...] = ("dataset",),
    row_id: str = "sample_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Shuffled batches of padded rows, one row per batch; the last of a dataset may be short.

    Each epoch has its own order. A batch is as long as its longest row. Ranking leaves the rows
    of a block in one partition, so batches within a block are put together without another
    shuffle; only the few that reach over a block border are shuffled again.
    """
    ranked = global_rank(
        df.select(*keys, row_id, "input_ids", "labels"), list(keys), row_id,
        f"{seed}:{epoch}", block_rows)
    first = F.col("batch_id") * batch_size + 1
    last = F.least(F.col("_n"), (F.col("batch_id") + 1) * batch_size)
    placed = ranked.withColumn(
        "batch_id", F.floor((F.col("rank") - 1) / F.lit(batch_size)).cast("bigint")
    ).withColumn("_whole", (first > F.col("_offset"))
                 & (last <= F.col("_offset") + F.col("_block_size")))
    rows = F.sort_array(F.collect_list(F.struct("rank", row_id, "input_ids", "labels")))
    longest = F.max(F.size("input_ids")).alias("max_len")
    whole = placed.filter("_whole").groupBy("_g", "_block", "batch_id").agg(
        rows.alias("_rows"), longest).drop("_block")
    crossing = placed.filter("not _whole").groupBy("_g", "batch_id").agg(
        rows.alias("_rows"), longest)

    def padded(column: str, filler: int) -> Column:
        return F.transform("_rows", lambda r: F.concat(
            r[column], F.array_repeat(F.lit(filler), F.col("max_len") - F.size(r[column]))))

    return whole.unionByName(crossing).select(
        *[F.col(f"_g.{k}").alias(k) for k in keys],
        "batch_id", F.size("_rows").alias("batch_rows"), "max_len",
        F.transform("_rows", lambda r: r[row_id]).alias("sample_ids"),
        padded("input_ids", pad_id).alias("input_ids"),
        padded("labels", fixed.IGNORED_LABEL).alias("labels"))


def plan_training(
    df: DataFrame,
    batch_size: int,
    accumulate: int = 1,
    epochs: int = 1,
    warmup: int = 0,
    keys: tuple[str, ...] = ("dataset",),
) -> DataFrame:
    """Batches and optimizer steps per dataset of a frame with `split`."""
    accumulate = max(1, accumulate)
    train = F.col("n_train")
    return (
        df.groupBy(*keys).agg(
            F.count_if(F.col("split") == "train").alias("n_train"),
            F.count_if(F.col("split") == "validation").alias("n_val"))
        .withColumn("batches", F.ceil(train / F.lit(batch_size)).cast("bigint"))
        .withColumn("steps_per_epoch", F.ceil(F.col("batches") / F.lit(accumulate)).cast("bigint"))
        .withColumn("total_steps", F.col("steps_per_epoch") * F.lit(epochs))
        .withColumn("warmup", F.least(F.lit(warmup).cast("bigint"), F.col("total_steps")))
    )

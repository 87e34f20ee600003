import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pairworks.operators import prepare as P


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_split_sizes_and_members(spark, share):
    sizes = {"one": 1, "two": 2, "nine": 9, "ten": 10, "eleven": 11, "big": 1234, None: 40}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, sample_id bigint")
    got = P.split_pairs(df, share).collect()
    again = P.split_pairs(df.repartition(7, "sample_id"), share).collect()
    assert set(map(tuple, got)) == set(map(tuple, again)) and len(got) == len(rows)
    for name, n in sizes.items():
        quota = max(1, int(n * share))
        quota = 0 if quota >= n else quota
        held = {r["sample_id"] for r in got if r["dataset"] == name and r["split"] == "validation"}
        assert held == set(order(range(n), 42)[:quota])


@pytest.mark.parametrize("texts", [1, 3, 1000])
def test_split_sizes_with_repeated_ids(spark, texts):
    """100 rows under 10 ids, a dataset of one row many times, and one of unique ids; texts may repeat too."""
    rows = [("a", i % 10, f"t{i // 10 % texts}") for i in range(100)] + [("same", 1, "t")] * 37 + [("one", i, "t") for i in range(20)] + [(None, 5, f"t{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "dataset string, sample_id bigint, text string").repartition(4)
    got = P.split_pairs(df, 0.15)
    assert got.columns == ["dataset", "sample_id", "text", "split"]
    held = {}
    for r in got.filter("split = 'validation'").collect():
        held[r["dataset"]] = held.get(r["dataset"], 0) + 1
    assert held == {"a": 15, "same": 5, "one": 3, None: 1}
    assert sorted(map(tuple, got.drop("split").collect()), key=str) == sorted(rows, key=str)
    again = P.split_pairs(df.repartition(7), 0.15)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    whole = P.split_pairs(df, 0.15, keys=()).filter("split = 'validation'").count()
    assert whole == len(rows) * 15 // 100


def test_wide_rows_are_not_shuffled_by_a_split(spark):
    df = spark.range(1000).selectExpr("id AS sample_id", "id % 3 AS dataset", "repeat('x', 50) AS text")
    plan = P.split_pairs(df, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_prompt_and_masks(spark):
    rows = [(1, "a b", "c d"), (2, "a", ""), (3, "w " * 20, "t"), (4, "", "x y z")]
    df = spark.createDataFrame(rows, "n int, input string, target string")
    text = {r["n"]: r for r in P.render_prompt(df, "</s>").collect()}
    assert text[1]["prompt"] == "Input: a b\nOutput:" and text[1]["text"] == "Input: a b\nOutput: c d</s>"
    got = {r["n"]: r for r in P.tokenize_and_mask(df, max_len=8).collect()}
    assert [r["n_tokens"] for r in (got[1], got[2], got[3], got[4])] == [7, 4, 8, 6]
    assert [got[n]["n_trainable"] for n in (1, 2, 3, 4)] == [3, 1, 0, 4]
    assert [got[n]["dead"] for n in (1, 2, 3, 4)] == [False, False, True, False]
    assert [got[n]["truncated"] for n in (1, 2, 3, 4)] == [False, False, True, False]
    for r in got.values():
        assert sum(x != -100 for x in r["labels"]) == r["n_trainable"]
        assert [a for a, b in zip(r["input_ids"], r["labels"]) if b != -100] == [
            b for b in r["labels"] if b != -100]
    assert got[1]["input_ids"][-1] == 0
    exact = P.tokenize_and_mask(df.filter("n = 1"), max_len=4).first()
    assert exact["dead"] and exact["truncated"] and len(exact["input_ids"]) == 4
    assert not P.tokenize_and_mask(df.filter("n = 1"), max_len=7).first()["truncated"]


def test_loaded_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {w: i for i, w in enumerate(["[UNK]", "</s>", "Input", ":", "Output", "a", "b"])}
    tok = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.add_special_tokens(["</s>"])
    path = str(tmp_path / "tokenizer.json")
    tok.save(path)

    def load():
        from tokenizers import Tokenizer
        loaded = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in loaded.encode_batch(texts)]

    df = spark.createDataFrame([("a", "b")], "input string, target string")
    made = P.tokenize_and_mask(df, P.LoadedTokenizer(load, "</s>", 1))
    row = made.first()
    assert row["input_ids"] == [2, 3, 5, 4, 3, 6, 1] and row["labels"] == [-100] * 5 + [6, 1]
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    short = P.tokenize_and_mask(df, P.LoadedTokenizer(load, "</s>", 1), max_len=4).first()
    assert short["input_ids"] == [2, 3, 5, 4] and short["truncated"] and short["dead"]


@pytest.mark.parametrize("block_rows", [5, 60, 100_000])
def test_batches(spark, block_rows):
    rows = [("hot" if i % 4 else "cold", i, [i] * (1 + i % 7), [-100] * (1 + i % 7)) for i in range(302)]
    df = spark.createDataFrame(
        rows, "dataset string, sample_id bigint, input_ids array<int>, labels array<int>").repartition(5)
    got = P.make_batches(df, 8, 999, epoch=2, block_rows=block_rows).collect()
    for name in ("hot", "cold"):
        ids = order([r[1] for r in rows if r[0] == name], "42:2")
        mine = sorted((r for r in got if r["dataset"] == name), key=lambda r: r["batch_id"])
        assert [r["batch_id"] for r in mine] == list(range(math.ceil(len(ids) / 8)))
        assert [i for r in mine for i in r["sample_ids"]] == ids
        for r in mine:
            longest = max(1 + i % 7 for i in r["sample_ids"])
            assert r["max_len"] == longest and r["batch_rows"] == len(r["sample_ids"])
            for i, ids_, labels in zip(r["sample_ids"], r["input_ids"], r["labels"]):
                real = 1 + i % 7
                assert ids_ == [i] * real + [999] * (longest - real) and labels == [-100] * longest


def test_batches_take_one_wide_shuffle(spark):
    df = spark.range(400).select(
        (F.col("id") % 3).alias("dataset"), F.col("id").alias("sample_id"),
        F.array(F.col("id")).alias("input_ids"), F.array(F.col("id")).alias("labels"))
    batches = P.make_batches(df, 8, 0, block_rows=20)
    batches.collect()
    plan = batches._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1
    assert len([line for line in plan.splitlines() if "+- Exchange hashpartitioning" in line]) == 2


def test_epochs_differ(spark):
    df = spark.range(50).select(F.lit("d").alias("dataset"), F.col("id").alias("sample_id"),
                                F.array(F.lit(1)).alias("input_ids"), F.array(F.lit(1)).alias("labels"))
    one, two = (
        [r["sample_ids"] for r in P.make_batches(df, 50, 0, epoch=e).collect()] for e in (0, 1))
    assert one != two and sorted(one[0]) == sorted(two[0])


def test_plan(spark):
    df = spark.createDataFrame(
        [("d", "train")] * 10 + [("d", "validation")] * 2 + [("e", "train")], "dataset string, split string")
    got = {r["dataset"]: tuple(r)[1:] for r in P.plan_training(df, 4, 2, 3, 50).collect()}
    assert got == {"d": (10, 2, 3, 2, 6, 6), "e": (1, 0, 1, 1, 3, 3)}
    assert P.plan_training(df, 4, 0, 1, 0).filter("dataset = 'd'").first()["steps_per_epoch"] == 3


def test_a_loaded_tokenizer_gets_few_texts_at_a_time(spark):
    """The first id tells the most memory, in KB, that Python objects have taken in the worker so far."""
    import tracemalloc

    from pairworks.operators.prepare import LoadedTokenizer, tokenize_and_mask

    def load():
        tracemalloc.start()

        def encode(texts):
            ids = [list(text.encode()) for text in texts]
            return [[tracemalloc.get_traced_memory()[1] // 1000, *found] for found in ids]
        return encode

    rows = spark.range(0, 400, 1, 1).selectExpr("id AS sample_id", "'d' AS dataset", "'in' AS input", "repeat(chr(97 + id % 26), 20000) AS target")
    got = tokenize_and_mask(rows, LoadedTokenizer(load, "!", 0), max_len=30000).selectExpr("sample_id", "input_ids").collect()
    assert sorted(r["sample_id"] for r in got) == list(range(400))
    assert all(set(r["input_ids"][-3:-1]) == {97 + r["sample_id"] % 26} and r["input_ids"][-1] == 33 for r in got)
    assert 0 < max(r["input_ids"][0] for r in got) < 45_000

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairworks.plans import ranking, running
from pairworks.plans.shared import materialise, new_path, shared_dir


def keyed_rows(seed, rows=400, hot=0.6):
    rng = random.Random(seed)
    out = []
    for seq in rng.sample(range(rows * 3), rows):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        out.append((key, seq, rng.randint(-3, 3)))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_a_loop(spark, chunk, inclusive):
    rows = keyed_rows(chunk)
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    long = running.long_keys(df, ["k"], "seq", chunk)
    assert (long is None) == (chunk == 10_000)
    got = running.running(running.cut(df, ["k"], "seq", long), "seq", {
        "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, inclusive, long).select(
        "k", "seq", "v", "s", "lo", "hi")
    seen, want = {}, set()
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(k, [])
        frame = [*past, v] if inclusive else list(past)
        folded = (sum(frame), min(frame), max(frame)) if frame else (None, None, None)
        want.add((k, seq, v, *folded))
        past.append(v)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_previous_equals_a_loop(spark, chunk):
    rows = keyed_rows(3)
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    long = running.long_keys(df, ["k"], "seq", chunk)
    got = running.previous(running.cut(df, ["k"], "seq", long), "seq", {"pv": "v", "ps": "seq"}, long).select(
        "k", "seq", "v", "pv", "ps")
    last, want = {}, set()
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        want.add((k, seq, v, *last.get(k, (None, None))))
        last[k] = (v, seq)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("orders", [
    [0, *range(1_700_000_000_000, 1_700_000_002_000)],
    [i * 1000 ** (i % 4) for i in range(2000)],
    [i << 20 for i in range(2000)],
    [2 ** (2 * k) for k in range(20)] * 20,
])
def test_chunks_are_cut_by_rows(spark, orders):
    df = spark.createDataFrame([("hot", x) for x in orders] + [("cold", 5), (None, 6)], "k string, seq bigint")
    chunks = running.cut(df, ["k"], "seq", running.long_keys(df, ["k"], "seq", 100))
    sizes = chunks.groupBy("k", "_chunk").agg(
        F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("k", "_chunk").collect()
    hot = [r for r in sizes if r["k"] == "hot"]
    assert sum(r["n"] for r in sizes) == len(orders) + 2 and len(hot) > 1
    assert all(r["n"] <= 100 for r in hot)
    assert all(a["high"] < b["low"] for a, b in zip(hot, hot[1:]))


def test_running_over_everything(spark):
    df = spark.range(100).withColumnRenamed("id", "seq")
    long = running.long_keys(df, [], "seq", 9)
    got = running.running(running.cut(df, [], "seq", long), "seq", {"s": ("sum", "seq")}, long=long)
    assert {r["seq"]: r["s"] for r in got.collect()} == {
        i: i * (i + 1) // 2 for i in range(100)}


def shuffled(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("block_rows", [3, 40, 100_000])
def test_global_rank_equals_a_sort(spark, block_rows):
    rows = [("hot" if i % 3 else "cold" if i % 2 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id bigint").repartition(5)
    got = ranking.global_rank(df, ["k"], "id", 9, block_rows).collect()
    for key in ("hot", "cold", None):
        ranked = [r["id"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["rank"])]
        assert ranked == shuffled([i for k, i in rows if k == key], 9)


def test_cuts_find_the_row_at_the_quota(spark):
    rows = [("a", i) for i in range(300)] + [("b", i) for i in range(5)] + [(None, 7)]
    df = spark.createDataFrame(rows, "k string, id bigint")
    order = {"id": F.col("id")}
    cuts = ranking.quota_cuts(df, ["k"], F.floor(F.col("id") / 16), order, lambda n: F.floor(n / 4))
    assert {(r["k"], r["n"], r["quota"], r["cut_id"]) for r in cuts.collect()} == {
        ("a", 300, 75, 74), ("b", 5, 1, 0)}
    kept = ranking.with_cuts(df, cuts, ["k"]).filter(ranking.at_or_before(order))
    assert kept.count() == 76


def test_stored_tables_live_in_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x").startswith(f"{folder}/pairworks/x-")
    stored = materialise(spark.range(5), "five")
    assert stored.count() == 5 and all(f.startswith(f"file://{folder}") for f in stored.inputFiles())


def test_only_a_local_master_may_go_without_a_shared_folder():
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    local = Session(**{"spark.master": "local[2]", "spark.app.id": "a"})
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(**{"spark.master": "yarn"}))

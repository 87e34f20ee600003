import random

import pytest

from pairworks.operators import catalog as C
from pairworks.operators import requests as Q


def replay(saves, n):
    lists = {}
    for user, _, model in sorted(saves, key=lambda s: s[1]):
        listed = lists.setdefault(user, [])
        if model and model not in listed:
            lists[user] = [model, *listed][:n]
    return {(u, i, m) for u, listed in lists.items() for i, m in enumerate(listed, 1)}


@pytest.mark.parametrize("chunk", [20, 100_000])
@pytest.mark.parametrize("models,n", [(3, 5), (6, 5), (40, 5), (30, 20)])
def test_history_equals_replay(spark, models, n, chunk):
    rng = random.Random(models + chunk)
    saves = [("hot" if rng.random() < 0.6 else rng.choice("ab"), 2 * i,
              rng.choice([f"m{rng.randrange(models)}", f"m{rng.randrange(3)}", None, ""]))
             for i in range(260)]
    df = spark.createDataFrame(saves, "user string, seq bigint, model string").repartition(3)
    assert {tuple(r) for r in C.recent_models(df, n, chunk).collect()} == replay(saves, n)


def test_search(spark):
    rows = [(f"Org/Model-{i}", i % 7, "text-generation" if i % 2 else "other") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, downloads int, pipeline_tag string")
    found = C.search_models(df, "model-1", "5")
    want = sorted((r for r in rows if "model-1" in r[0].lower() and r[2] == "text-generation"),
                  key=lambda r: (-r[1], r[0]))[:5]
    assert [tuple(r) for r in found.collect()] == want
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    assert [C.search_limit(v) for v in (None, "", "0", "-1", "101", "x", "100", 7)] == [
        20, 20, 20, 20, 20, 20, 100, 7]


BASE = {"job": None, "repo": None, "filename": None, "quantization": None, "limit": None, "sharpness": None,
        "seed_input": None, "seed_output": None, "count": None}
SCHEMA = ("job string, repo string, filename string, quantization string, limit double, sharpness int, "
          "seed_input string, seed_output string, count int")
BAD = [
    (dict(job="import"), "Repo required"), (dict(job="import", repo="no-slash"), "Invalid repository"),
    (dict(job="smart_import", repo="a/b/c"), "Invalid repository"), (dict(job="clean"), "Filename required"),
    (dict(job="clean", filename="a/b"), "Invalid filename"), (dict(job="delete", filename="a\\b"), "Invalid filename"),
    (dict(job="select", filename="x" * 256), "Invalid filename"), (dict(job="select", filename=".."), "Invalid path"),
    (dict(job="clean", filename="gone.jsonl"), "File not found"),
    (dict(job="convert", quantization="q2"), "Invalid quantization"),
    (dict(job="evaluate", limit=0.001), "Limit must be"), (dict(job="evaluate", limit=float("nan")), "Limit must be"),
    (dict(job="judge", limit=1.5), "Limit must be"), (dict(job="judge", sharpness=101), "Sharpness must be"),
    (dict(job="judge", sharpness=-1), "Sharpness must be"),
    (dict(job="generate", seed_input="a", seed_output="b"), "Missing fields"),
    (dict(job="frobnicate", filename="../x"), "Unknown job"), (dict(job=None), "Unknown job"),
    (dict(job="generate", seed_input="a", seed_output="", count=3), "Missing fields"),
]
GOOD = [
    (dict(job="import", repo="own-er_1/re.po-1"), {"split": "train"}),
    (dict(job="clean", filename="here.jsonl", count=500), {"count": 500}), (dict(job="convert"), {"quantization": "q8_0", "model": "tuned"}),
    (dict(job="evaluate", limit=0.0), {"limit": 1.0}), (dict(job="judge"), {"limit": 0.2, "sharpness": 50}),
    (dict(job="judge", sharpness=0, limit=0.01, quantization="f16"), {"sharpness": 50, "limit": 0.01}),
    (dict(job="generate", seed_input="a", seed_output="b", count=99), {"count": 50}),
]


def test_requests(spark):
    rows = [tuple({**BASE, **r}.values()) for r, _ in BAD + GOOD]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {SCHEMA}")
    files = spark.createDataFrame([("here.jsonl",)], "name string")
    accepted, rejected = Q.validate_requests(df, files, 50)
    bad = {r["n"]: r["error_message"] for r in rejected.collect()}
    assert set(bad) == set(range(len(BAD)))
    assert all(bad[i].startswith(message) for i, (_, message) in enumerate(BAD))
    for r in accepted.collect():
        request, want = GOOD[r["n"] - len(BAD)]
        assert {k: r[k] for k in want} == want, request


def test_requests_as_text(spark):
    df = spark.createDataFrame(
        [(1, "judge", "0.5x", "30"), (2, "judge", "", "30.9"), (3, "judge", "zero", "x")],
        "n int, job string, limit string, sharpness string")
    accepted, rejected = Q.validate_requests(df, max_count=50)
    assert {(r["n"], r["limit"], r["sharpness"]) for r in accepted.collect()} == {(1, 0.5, 30), (2, 0.2, 30)}
    assert [r["n"] for r in rejected.collect()] == [3]

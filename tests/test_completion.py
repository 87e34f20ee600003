import io
import json

import pytest

from pairworks.operators import completion as C

SEEDS = "n int, seed_input string, seed_output string, count int"


@pytest.fixture
def echo():
    def client():
        def call(prompt, temperature, timeout):
            if "fail" in prompt:
                raise ValueError("no")
            return f"{prompt}|{temperature}|{timeout}"
        return call
    return client


def test_calls_are_isolated(spark, echo):
    df = spark.createDataFrame([(1, "a"), (2, "fail"), (3, "c")], "n int, prompt string")
    called = C.complete(df, "prompt", echo, 0.5, 9, partitions=2, calls_per_task=3)
    got = {r["n"]: r for r in called.collect()}
    assert got[1]["reply"] == "a|0.5|9" and got[1]["error"] is None
    assert got[2]["reply"] is None and got[2]["error"] == "ValueError: no"


def test_other_columns_come_through_unchanged(spark, echo):
    df = spark.createDataFrame(
        [(2**60 + 1, None, [1, None], "a"), (None, {"k": 1.5}, None, "b")],
        "big bigint, m map<string,double>, l array<int>, prompt string")
    got = C.complete(df, "prompt", echo).select("big", "m", "l", "prompt").collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))


def test_finished_calls_are_not_made_again(spark, echo):
    df = spark.createDataFrame([(1, "a"), (2, "fail"), (3, "c")], "n int, prompt string")
    done = C.complete_once(df, ["n"], "prompt", echo, temperature=0.1)
    changed = spark.createDataFrame([(1, "a"), (2, "fail"), (3, "new"), (4, "d")], "n int, prompt string")
    got = C.complete_once(changed, ["n"], "prompt", echo, done, temperature=0.9)
    replies = {r["n"]: r["reply"] for r in got.collect()}
    assert replies == {1: "a|0.1|300", 2: None, 3: "new|0.9|300", 4: "d|0.9|300"}


def logged(calls, broken=None):
    """A client that writes down its calls; while the file `broken` is there, "p7" ends its worker."""
    refusal = C.ModelError

    def client():
        def call(prompt, temperature, timeout):
            if prompt == "p7" and broken is not None and broken.exists():
                raise SystemExit("lost")
            with calls.open("a") as log:
                log.write(prompt + "\n")
            if prompt == "p3":
                raise refusal(503, "busy")
            return prompt.upper()
        return call
    return client


def test_a_run_that_breaks_off_keeps_the_replies_of_its_tasks(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    broken.touch()
    df = spark.range(0, 40, 1, 16).selectExpr("id AS n", "concat('p', id) AS prompt").filter("n <> 3")
    path = str(tmp_path / "ledger")
    run = lambda: C.complete_once(df, ["n"], "prompt", logged(calls, broken), path=path, partitions=40)
    with pytest.raises(Exception):
        run()
    kept = {r["reply"].lower() for r in C.Ledger(spark, path).rows().collect()}
    assert kept
    broken.unlink()
    calls.write_text("")
    assert {(r["n"], r["reply"]) for r in run().collect()} == {(i, f"P{i}") for i in range(40) if i != 3}
    assert sorted(calls.read_text().split()) == sorted({f"p{i}" for i in range(40) if i != 3} - kept)


def test_a_ledger_serves_other_rows_and_other_partitions(spark, tmp_path):
    calls = tmp_path / "calls"
    path = str(tmp_path / "ledger")

    def run(n, **options):
        calls.write_text("")
        df = spark.range(n).selectExpr("IF(id = 5, NULL, id) AS n", "concat('p', id) AS prompt")
        got = C.complete_once(df.unionByName(df.filter("n = 2")), ["n"], "prompt", logged(calls), path=path, **options).collect()
        assert len(got) == n + 1
        assert all(r["reply"] == r["prompt"].upper() and r["status"] == 200 or r["prompt"] == "p3" for r in got)
        assert {(r["error"], r["status"]) for r in got if r["prompt"] == "p3"} == {("ModelError: model API returned 503: busy", 503)}
        return sorted(calls.read_text().split())

    assert run(20, partitions=8) == sorted(f"p{i}" for i in range(20))
    assert run(20, partitions=3) == ["p3"]
    assert run(30) == sorted(["p3", *[f"p{i}" for i in range(20, 30)]])
    assert run(10) == ["p3"]
    # A task that was run twice has left its replies twice.
    C.Ledger(spark, path).append(C.Ledger(spark, path).rows())
    assert run(30, partitions=5) == ["p3"]


@pytest.mark.parametrize("status,body", [
    (500, "oops"), (200, "{}"), (200, '{"choices": []}'), (200, '{"choices": [{}]}'),
    (200, '{"choices": [{"message": {"content": ""}}]}'), (200, "not json")])
def test_unusable_replies(status, body):
    with pytest.raises(Exception):
        C.read_completion(status, body)


def test_http_request(monkeypatch):
    sent = {}

    class Reply(io.BytesIO):
        status = 200

    def urlopen(request, timeout):
        sent.update(url=request.full_url, timeout=timeout, **json.loads(request.data))
        return Reply(b'{"choices": [{"message": {"content": "hi"}}]}')

    monkeypatch.setattr(C.urllib.request, "urlopen", urlopen)
    assert C.HttpChat("http://model:1/", max_tokens=64)()("p", 0.8, 5) == "hi"
    assert sent == {"url": "http://model:1/v1/chat/completions", "timeout": 5, "temperature": 0.8,
                    "stream": False, "max_tokens": 64, "messages": [{"role": "user", "content": "p"}]}


def test_refused_requests_keep_their_status(monkeypatch):
    def urlopen(request, timeout):
        assert json.loads(request.data)["messages"] == [{"role": "system", "content": "a"}, {"role": "user", "content": "b"}]
        raise C.urllib.error.HTTPError(request.full_url, 429, "no", {}, io.BytesIO(b"later"))

    monkeypatch.setattr(C.urllib.request, "urlopen", urlopen)
    with pytest.raises(C.ModelError, match="429: later") as refused:
        C.HttpChat("http://model:1", as_messages=True)()('[{"role": "system", "content": "a"}, {"role": "user", "content": "b"}]', 0, 5)
    assert refused.value.status == 429


def test_variations(spark):
    seeds = spark.createDataFrame(
        [(1, "in", "out", 70), (2, "", "out", 1), (3, "in", None, 1), (4, "in", "out", 0)], SEEDS)
    prompts, rejected = C.variation_prompts(seeds, 50)
    row = prompts.first()
    assert row["count"] == 50 and "generate 50 distinct" in row["prompt"]
    assert 'Seed Input: "in"' in row["prompt"] and '[{"input": "...", "target": "..."}, ...]' in row["prompt"]
    assert {r["n"] for r in rejected.collect()} == {2, 3, 4}
    replies = spark.createDataFrame([
        (1, '```json\n[{"input": "a", "target": "b"}, {"input": "c"}, {"target": 5}]\n```'),
        (2, "[]"), (3, "sorry"), (4, '{"input": "a"}'), (5, None)], "n int, reply string")
    rows, bad = C.parse_variations(replies, ["n"])
    assert {tuple(r) for r in rows.collect()} == {(1, 0, "a", "b"), (1, 1, "c", None), (1, 2, None, "5")}
    assert {r["n"] for r in bad.collect()} == {3, 4, 5}


def test_replies_are_held_for_few_rows_at_a_time(spark):
    """A reply tells the most memory that Python objects have taken in the worker so far; Arrow's batch takes 20 MB and more of it."""
    import tracemalloc

    from pairworks.operators.completion import complete

    def model():
        tracemalloc.start()
        return lambda prompt, temperature, timeout: f"{prompt[:8]} {tracemalloc.get_traced_memory()[1]} " + "x" * 20000

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "CASE WHEN id % 50 > 0 THEN concat(lpad(id, 8, '0'), repeat('y', 20000)) ELSE lpad(id, 8, '0') END AS prompt")
    for calls in (1, 4):
        got = complete(rows, "prompt", model, calls_per_task=calls).selectExpr("id", "split(reply, ' ') AS told", "error").collect()
        assert [(r["id"], int(r["told"][0]), r["error"]) for r in sorted(got)] == [(i, i, None) for i in range(1000)]
        assert max(int(r["told"][1]) for r in got) < 64_000_000


def test_parts_hold_every_row_once():
    import pyarrow as pa

    from pairworks.operators import completion

    for sizes in ([], [0], [None] * 3, [3_000_000, 10, 3_000_000], [10] * 1000, [600_000] * 5):
        batch = pa.RecordBatch.from_arrays([pa.array([None if s is None else "x" * s for s in sizes], pa.string()), pa.array(range(len(sizes)), pa.int64())], ["p", "i"])
        for least in (1, 4, 300):
            parts = list(completion._parts(batch, "p", least))
            assert [i for part in parts for i in part.column("i").to_pylist()] == list(range(len(sizes))) and all(part.num_rows for part in parts)
            assert all(part.num_rows <= max(least, completion.ROWS_AT_ONCE) for part in parts)

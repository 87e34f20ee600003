import json
import random
from datetime import datetime

import pytest

from pairworks.operators import monitor as M

LINES = "run_id string, seq bigint, line string, channel string"


def test_log_lines(spark):
    metric = {"loss": 0.5, "grad_norm": 1.25, "learning_rate": 5e-05, "epoch": 1.5, "step": 7}
    rows = [
        ("r", 1, json.dumps(metric), None), ("r", 2, '{"message": "hi"}', "stdout"),
        ("r", 3, '{"warning": "w"}', None), ("r", 4, '{"error": "e"}', None),
        ("r", 5, '{"status": "complete", "message": "done", "saved_to": "x"}', None),
        ("r", 6, "plain text", None), ("r", 7, "{broken", None), ("r", 8, '{"message": "m"}', "stderr"),
        ("r", 9, "no such file", "spawn"), ("r", 10, '{"loss": NaN}', None), ("r", 11, "42", None),
        ("r", 12, '{"loss": 0, "step": 3}', None),
    ]
    got = {r["seq"]: r for r in M.parse_log_stream(spark.createDataFrame(rows, LINES)).collect()}
    assert [got[i]["kind"] for i in range(1, 13)] == [
        "metric", "message", "warning", "error", "status", "raw", "raw", "stderr", "error", "raw", "raw", "metric"]
    assert [got[i]["text"] for i in range(1, 13)] == [
        None, "hi", "w", "e", "done", "plain text", "{broken", '{"message": "m"}', "no such file",
        '{"loss": NaN}', "42", None]
    assert {m: got[1][m] for m in metric} == metric


def test_latest_metrics_and_cards(spark):
    rows = [("a", 5, 0.5, None, 5e-5, 1.0, 5), ("a", 9, 0.0, 9.0, 9.0, 9.0, 9), ("a", 7, None, 1.0, 1.0, 1.0, 7),
            ("a", 6, float("nan"), 1.0, 1.0, 1.0, 6), ("b", 1, 2.0, 3.0, 1.5e-3, 0.25, 1),
            ("b", 3, 1.23456, 2.0, 1e-10, 0.5, 3), ("c", 1, 0.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, loss double, grad_norm double, "
                                     "learning_rate double, epoch double, step bigint")
    latest = M.latest_metrics(df)
    assert {(r["run_id"], r["seq"], r["loss"], r["grad_norm"]) for r in latest.collect()} == {
        ("a", 5, 0.5, None), ("b", 3, 1.23456, 2.0)}
    assert {tuple(r) for r in M.metric_cards(latest).collect()} == {
        ("a", "1.00", "0.5000", "5.00e-5", "-"), ("b", "0.50", "1.2346", "1.00e-10", "2.00")}


def test_log_tail(spark):
    rows = [(run, i) for run, n in (("x", 100), ("y", 101), ("z", 102)) for i in range(n)]
    random.Random(1).shuffle(rows)
    tail = M.recent_logs(spark.createDataFrame(rows, "run_id string, seq bigint"))
    got = {(r["run_id"], r["seq"]) for r in tail.collect()}
    assert got == set(rows) - {("z", 0)}
    assert "WindowGroupLimit" in tail._jdf.queryExecution().executedPlan().toString()


def test_file_sizes(spark):
    rows = [("m.gguf", 10, datetime(2024, 1, 1)), ("m.gguf", 5242880, datetime(2024, 1, 3)),
            ("m.gguf", 20, datetime(2024, 1, 2)), ("r.json", 1, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "file string, size bigint, ts timestamp")
    assert {tuple(r) for r in M.latest_file_sizes(df).collect()} == {
        ("m.gguf", 5242880, 5.0), ("r.json", 1, 0.0)}


def test_run_status(spark):
    rows = [("a", 1, True, 11, None, None), ("a", 9, False, None, 0, None), ("b", 2, True, 12, None, None),
            ("c", 3, True, 13, None, None), ("c", 4, False, None, None, True), ("c", 5, False, None, 1, None)]
    df = spark.createDataFrame(
        rows, "run_id string, seq bigint, running boolean, pid int, code int, killed boolean")
    got = {r["run_id"]: (r["running"], r["code"], r["killed"]) for r in M.run_status(df).collect()}
    assert got == {"a": (False, 0, False), "b": (True, None, False), "c": (False, 1, True)}


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_overlapping_runs(spark, chunk):
    rng = random.Random(chunk)
    runs = [(f"r{i}", s, None if rng.random() < 0.02 else s + rng.randint(1, 30))
            for i, s in enumerate(rng.sample(range(2000), 100))]
    want, active = set(), -1
    for name, start, end in sorted(runs, key=lambda r: r[1]):
        if active > start:
            want.add(name)
        active = max(active, 2**63 - 1 if end is None else end)
    df = spark.createDataFrame(runs, "run_id string, started bigint, ended bigint")
    assert {r["run_id"] for r in M.overlapping_runs(df, chunk).collect()} == want


def chunked(rng, text):
    out = []
    while text:
        n = rng.choice([1, 2, 3, 7, 20, 60])
        out.append(text[:n])
        text = text[n:]
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 8])
def test_lines_out_of_chunks_cut_anywhere(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "long_keys", lambda df, keys, order, real=M.long_keys: real(df, keys, order, chunk))
    rng = random.Random(7)
    rows, want = [], []
    for run in ("a", "b", None):
        for channel in ("stdout", "stderr"):
            lines = ["".join(rng.choice("xyé {}") for _ in range(rng.choice([0, 0, 1, 5, 40]))) for _ in range(30)]
            text = "\n".join(lines) + rng.choice(["", "\n"])
            rows += [(run, channel, 3 * i, piece) for i, piece in enumerate(chunked(rng, text))]
            ended = text.split("\n")
            want += [(run, channel, i + 1, line) for i, line in enumerate(ended if ended[-1] else ended[:-1])]
    rows.append(("c", "stdout", 1, None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id string, channel string, seq bigint, data string")
    got = M.chunk_lines(df)
    assert got.columns == ["run_id", "channel", "line_no", "line"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert M.chunk_lines(df.limit(0)).count() == 0


def test_lines_out_of_a_stream_of_chunks(spark, tmp_path):
    """Lines reach over micro-batches and restarts; what has not ended is not told."""
    from pairworks.streaming.lines import chunk_lines
    from pairworks.streaming.newest import start_newest

    rng = random.Random(8)
    schema = "run_id string, channel string, seq bigint, data string"
    texts = {(run, channel): "\n".join("".join(rng.choice("xyé ") for _ in range(rng.choice([0, 3, 90]))) for _ in range(12)) + end
             for (run, channel), end in zip([("a", "stdout"), ("a", "stderr"), ("b", "stdout")], ["\n", " not ended", ""])}
    chunks = {key: chunked(rng, text) for key, text in texts.items()}
    for part in range(3):
        rows = [(*key, i, piece) for key, pieces in chunks.items() for i, piece in enumerate(pieces) if i * 3 // len(pieces) == part]
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start_newest(chunk_lines(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"),
                     once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted((*key, i + 1, line) for key, text in texts.items() for i, line in enumerate(text.split("\n")[:-1]))

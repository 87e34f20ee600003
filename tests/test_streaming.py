import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairworks.operators import monitor as M
from pairworks.operators import rules as R
from pairworks.streaming import monitor as SM
from pairworks.streaming import rules as SR
from pairworks.streaming.batches import BatchTable
from test_rules import random_changes, replay, rule_rows, want_rows


def write_parts(df, path, parts):
    """One file per part, in the order of `seq`."""
    rows = df.count()
    for i in range(parts):
        df.filter((F.col("seq") >= i * rows // parts) & (F.col("seq") < (i + 1) * rows // parts)).coalesce(
            1).write.mode("append").json(path)


def state(spark, checkpoint):
    """The orders kept per key in a stream's state store."""
    rows = spark.read.format("statestore").option("stateVarName", "orders").load(str(checkpoint)).collect()
    kept = {}
    for r in rows:
        kept.setdefault(r["key"][0], []).append(r["list_element"]["at"])
    return {key: sorted(orders) for key, orders in kept.items()}


def test_log_streams_equal_batches(spark, tmp_path):
    """Rows come late, twice and without a run; every part is a micro-batch or a run of its own."""
    rng = random.Random(4)
    order = rng.sample(range(400), 400)
    rows = [(rng.choice(["hot", "hot", "cold", None]), s,
             json.dumps({"loss": rng.choice([0, 0.5, 1.5]), "step": s}) if s % 5 else "text", None)
            for s in order]
    rows = rows[:200] + rows[150:]
    out, checkpoints = tmp_path / "out", tmp_path / "checkpoints"
    for i in range(3):
        for part in range(2):
            some = rows[(2 * i + part) * 75:(2 * i + part + 1) * 75]
            spark.createDataFrame(some, SM.LINE_SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        batch = M.parse_log_stream(SM.read_log_lines(spark, str(tmp_path / "log")))
        tail = M.parse_log_stream(spark.readStream.schema(SM.LINE_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log")))
        SM.start_metrics(batch, str(out / "metrics"), str(checkpoints / "metrics"), once=True).awaitTermination()
        SM.start_recent_logs(tail.select("run_id", "seq", "kind", "text"), str(out / "tail"), str(checkpoints / "tail"), n=31, once=True).awaitTermination()
        seen = M.parse_log_stream(spark.createDataFrame(rows[:150 * (i + 1)], SM.LINE_SCHEMA))
        got = M.latest_metrics(spark.read.parquet(str(out / "metrics")))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in M.latest_metrics(seen).collect()}
        got = M.recent_logs(spark.read.parquet(str(out / "tail")), 31)
        want = M.recent_logs(seen.select("run_id", "seq", "kind", "text"), 31)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    # What was too old when it came has not gone on, and the state holds the newest orders.
    assert spark.read.parquet(str(out / "tail")).count() < 400
    assert state(spark, checkpoints / "tail")["hot"] == sorted(r["seq"] for r in want.collect() if r["run_id"] == "hot")


def test_state_of_ended_runs_is_dropped(spark, tmp_path):
    schema = "run_id string, seq bigint, running boolean, pid int, code int, killed boolean"
    steps = [
        [("a", 1, True, 10, None, None), ("b", 2, True, 11, None, None), ("c", 3, True, 12, None, None)],
        [("a", 4, False, None, 0, True), ("b", 5, False, None, 1, False)],
        [("b", 6, True, 13, None, None), ("c", 7, True, 14, None, None)],
        [("c", 8, True, 15, None, None), ("a", 2, True, 9, None, None), ("a", 3, False, None, 9, True)],
        [("c", 9, True, 16, None, None)],
    ]
    told, kept = [], []
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        SM.start_status(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"),
                        once=True, keep_ms=0).awaitTermination()
        told += step
        want = M.run_status(spark.createDataFrame(told, schema))
        assert {tuple(r) for r in M.run_status(spark.read.parquet(str(tmp_path / "out"))).collect()} == {tuple(r) for r in want.collect()}
        kept.append(state(spark, tmp_path / "c"))
    assert kept[0] == {"a": [1], "b": [2], "c": [3]}
    # Run a has ended and is gone by the next micro-batch; run b started again, and stays.
    assert "a" not in kept[2] and kept[2]["b"] == [6] and kept[4]["b"] == [6] and kept[4]["c"] == [9]


def test_a_file_that_grows(spark, tmp_path):
    schema = "file string, size bigint, ts timestamp"
    rows = [("m", i * 100, f"2024-01-01 00:00:{i:02d}") for i in (3, 1, 5, 4)] + [("m", 700, "2024-01-01 00:00:05"), ("n", 1, "2024-01-01 00:00:00")]
    for i in (0, 3):
        spark.createDataFrame(rows[i:i + 3], "file string, size bigint, ts string").selectExpr("file", "size", "CAST(ts AS timestamp) AS ts").coalesce(
            1).write.mode("append").parquet(str(tmp_path / "in"))
        SM.start_file_sizes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    assert {(r["file"], r["size"]) for r in M.latest_file_sizes(spark.read.parquet(str(tmp_path / "out"))).collect()} == {("m", 700), ("n", 1)}


@pytest.mark.parametrize("ignore_initial", [True, False])
def test_sizes_of_watched_folders(spark, tmp_path, ignore_initial):
    """Every step is a run of its own: what a listing sees new or changed goes on, once."""
    models = tmp_path / "models"
    (models / "sub").mkdir(parents=True)
    (models / "old.gguf").write_text("1")
    steps = [
        ({}, {} if ignore_initial else {"old.gguf": 1}),
        ({"new.gguf": "22", "sub/deep.gguf": "333", "notes.txt": "x"}, {"new.gguf": 2, "deep.gguf": 3}),
        ({}, {}),
        ({"old.gguf": "4444", "sub/deep.gguf": None}, {"old.gguf": 4}),
        ({"sub/deep.gguf": "55555"}, {"deep.gguf": 5}),
    ]
    told = 0
    for i, (writes, want) in enumerate(steps):
        for name, text in writes.items():
            (models / name).unlink(missing_ok=True)
            if text is not None:
                (models / name).write_text(text)
                if name == "new.gguf":
                    os.utime(models / name, (1e9, 1e9))  # comes with an old time
        SM.start_watched_sizes(spark, str(models), str(tmp_path / "out"), str(tmp_path / "c"), "*.gguf",
                               ignore_initial=ignore_initial, once=True).awaitTermination()
        rows = spark.read.schema("file string, size bigint, ts timestamp").parquet(str(tmp_path / "out")).orderBy("ts").collect()
        assert {r["file"]: r["size"] for r in rows[told:]} == want and len(rows) == told + len(want), i
        told = len(rows)
    sizes = M.latest_file_sizes(spark.read.parquet(str(tmp_path / "out")))
    assert {r["file"]: r["size"] for r in sizes.collect()} == {"new.gguf": 2, "old.gguf": 4, "deep.gguf": 5}


def test_a_flood_is_thinned_before_its_state(spark):
    import pyarrow as pa

    from pairworks.streaming.newest import _thin

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i % 17 == 0, i % 19 == 0) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["k", "_order", "_ends", "_always"])
    got = [tuple(r.values()) for r in _thin(batch, "k", 5).to_pylist()]
    least = {k: sorted((r[1] for r in rows if r[0] == k), reverse=True)[4] for k in ("a", "b", None)}
    assert got == [r for r in rows if r[1] >= least[r[0]] or r[2] or r[3]]


def test_rule_stream_and_routing(spark, tmp_path):
    changes = random_changes(21, 120)
    for i in range(3):
        spark.createDataFrame(changes[40 * i: 40 * (i + 1)], R.CHANGE_SCHEMA).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(R.CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    table = BatchTable(spark, str(tmp_path / "rules"), R.RULE_SCHEMA, "id")
    assert table.latest().count() == 0
    SR.start_rule_changes(
        stream, table, str(tmp_path / "rejects"), str(tmp_path / "c1"), once=True).awaitTermination()
    want, refused = replay(changes)
    assert rule_rows(table.latest()) == want_rows(want)
    got = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert {(r["seq"], r["error_code"]) for r in got} == set(refused)

    schema = "conv_id bigint, messages array<struct<role: string, content: string>>"
    texts = [r["trigger"] for r in want if r.get("trigger")][:5] + ["unheard of"]
    requests = spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(texts)] + [(99, [])], schema)
    requests.write.parquet(str(tmp_path / "requests"))
    SR.start_routing(spark.readStream.schema(schema).parquet(str(tmp_path / "requests")), table,
                     str(tmp_path / "out"), str(tmp_path / "c2"), once=True).awaitTermination()
    routed = spark.read.parquet(str(tmp_path / "out/routed"))
    batch, _ = R.route_requests(requests, table.latest())
    assert {(r["conv_id"], r["route"], r["matched_id"]) for r in routed.collect()} == {
        (r["conv_id"], r["route"], r["matched_id"]) for r in batch.collect()}
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1


def test_rule_stream_looks_rules_up_once(spark, tmp_path):
    """Each micro-batch reads the rules it touches once, and no others reach the fold."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    class Counting(BatchTable):
        def before(self, *args):
            rows = super().before(*args)
            return rows.mapInArrow(counted, rows.schema)

    def log(start):
        return [(start + i, None, "PUT" if start else "POST", str(i), {"trigger": f"t{start}"}) for i in range(0, 40, 4 if start else 1)]

    table, path = Counting(spark, str(tmp_path / "rules"), R.RULE_SCHEMA, "id"), str(tmp_path / "log")
    for start in (0, 100):
        spark.createDataFrame(log(start), R.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(R.CHANGE_SCHEMA).parquet(path)
        SR.start_rule_changes(stream, table, str(tmp_path / "rejects"), str(tmp_path / "c"), once=True).awaitTermination()
    assert read.value == 10
    assert Counter(r["trigger"] for r in table.latest().collect()) == {"t0": 30, "t100": 10}


def test_changed_keys(spark, tmp_path):
    """Against a dict; keys lose all rows, and micro-batches run again."""
    rng = random.Random(9)
    table = BatchTable(spark, str(tmp_path / "t"), "k string, v int", "k")
    want = {}
    for batch in range(7):
        touched = rng.sample(["a", "b", "c", "d", None], 3)
        change = {k: [rng.randrange(100) for _ in range(rng.choice([0, 1, 2]))] for k in touched}
        keys = spark.createDataFrame([(k,) for k in touched], "k string")
        rows = spark.createDataFrame([(k, v) for k, vs in change.items() for v in vs], "k string, v int")
        before = {tuple(r) for r in table.before(batch).collect()}
        if batch in (2, 5):
            table.put(batch, rows, keys)
            assert {tuple(r) for r in table.before(batch).collect()} == before
        table.put(batch, rows, keys)
        want.update(change)
        got = sorted(map(tuple, table.latest().collect()), key=str)
        assert got == sorted(((k, v) for k, vs in want.items() for v in vs), key=str)
    some = spark.createDataFrame([("a",), ("c",), (None,), ("unknown",)], "k string")
    assert sorted(map(repr, table.before(7, some).collect())) == sorted(map(repr, table.touching(table.before(7), some).collect()))
    assert {r["k"] for r in table.touching(table.latest(), spark.createDataFrame([("a",), (None,)], "k string")).collect()} <= {"a", None}


def test_temporary_tables_go(spark, tmp_path):
    from pathlib import Path

    from pairworks.plans.shared import materialise, new_path, temporary_tables

    with temporary_tables(spark):
        stored = materialise(spark.range(3), "gone")
        folder = Path(stored.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.exists()
    kept = new_path(spark, "kept")
    spark.range(1).write.parquet(kept)
    assert Path(kept).exists()


def test_a_stream_has_few_state_partitions_and_thins_what_has_ended(spark, tmp_path):
    """However many partitions shuffles have; the newest row of a key that floods the log is all its state gets."""
    import pyarrow as pa

    from pairworks.streaming import newest

    rows = [(f"run{i % 40}", i, i % 3 > 0, None, None, False) for i in range(2000)]
    schema = "run_id string, seq bigint, running boolean, pid int, code int, killed boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        SM.start_status(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in (tmp_path / "c/state/0").iterdir() if p.name.isdigit()]) == 16
    want = M.run_status(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in M.run_status(spark.read.parquet(str(tmp_path / "out"))).collect()} == {tuple(r) for r in want.collect()}
    columns = [["a"] * 500, list(range(500)), [True] * 500, [i == 7 for i in range(500)]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k:k + 50]) for c in columns], ["k", "_order", "_ends", "_always"]) for k in range(0, 500, 50)]
    thinned = [newest._thin(batch, "k", 1, ("_always",)).column("_order").to_pylist() for batch in newest._gathered(iter(batches))]
    assert thinned == [[7, 499]]

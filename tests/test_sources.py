import json
import os

import pytest
from pyspark.sql import functions as F

from pairworks.sources import files as S
from pairworks.sources import lines as L
from pairworks.sources import tables as T


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name, n, end in (("big.jsonl", 4000, "\n"), ("small.jsonl", 3, ""), ("one.jsonl", 1, "\n")):
        body = "\n".join(f"{i} " + "x" * (i * 7 % 90) for i in range(1, n + 1)) + end
        (tmp_path / name).write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("2000b", "31kb", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = L.with_line_no(spark, str(tmp_path)).select(
                F.substring_index("file", "/", -1).alias("f"), "line_no", "file_lines",
                F.substring_index("value", " ", 1).cast("bigint").alias("said")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(rows) == 4004
        assert all(r["line_no"] == r["said"] for r in rows)
        assert {(r["f"], r["file_lines"]) for r in rows} == {
            ("big.jsonl", 4000), ("small.jsonl", 3), ("one.jsonl", 1)}


def test_pairs_and_rejects(spark, tmp_path):
    lines = [
        '{"input": "a", "target": "b", "score": 3}', "", "   ", " ", '{"input": "a"', '{"input": 1} x',
        '{"input": "only"}', '{"input": "n", "target": NaN}', '[1]', '5', '{"input": 1, "target": null}',
        '{"input": "last", "target": "z"}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows, rejects = L.read_pairs_jsonl(
        spark, str(tmp_path), extra={"score": "int"}, numbered=True)
    got = {r["line_no"]: (r["input"], r["target"], r["target_missing"], r["score"]) for r in rows.collect()}
    assert got == {
        1: ("a", "b", False, 3), 7: ("only", "", True, None), 11: ("1", "", True, None),
        12: ("last", "z", False, None)}
    assert sorted(r["line_no"] for r in rejects.collect()) == [5, 6, 8, 9, 10]
    with pytest.raises(Exception, match="not a JSON object"):
        L.read_pairs_jsonl(spark, str(tmp_path), strict=True)[0].count()


def test_long_texts_are_read(spark):
    # 30 million characters are beyond try_parse_json, 140 million beyond a VARIANT.
    sizes = [5, 30_000_000, 140_000_000]
    line = lambda n, after: F.concat(
        F.lit('{"k": 7, "input": "é'), F.repeat(F.lit("x"), F.col("id").cast("int") + n), F.lit('", "target": null}'), F.lit(after))
    found, ends = [], ("", ' x', ', {"a": 1}')
    for n in sizes:
        for after in ends:
            df = spark.range(1).select(line(n, after).alias("value"))
            rows, rejects = L.parse_pairs(df, {"k": "int"})
            got = rows.select(F.length("input").alias("n"), F.right("input", F.lit(1)).alias("end"), "target", "target_missing", "k").collect()
            found.append([tuple(r) for r in got])
            assert rejects.select("error_code").count() == (1 if after else 0)
    assert found == [[(n + 1, "x", "", True, 7)] if end == "" else [] for n in sizes for end in ends]


def test_round_trip_replaces_only_written_datasets(spark, tmp_path):
    path = str(tmp_path / "pairs")
    df = spark.createDataFrame(
        [("a/1 +é", "x\ny", "é"), ("a/1 +é", "", "t"), ("b", "q", "r")], "dataset string, input string, target string")
    T.write_pairs_jsonl(df, path)
    T.write_pairs_jsonl(df.filter("dataset = 'b'").withColumn("target", F.lit("new")), path)
    rows, _ = L.read_pairs_jsonl(spark, f"{path}/*/*.json")
    got = rows.select(T.dataset_name(F.col("file")).alias("d"), "input", "target").collect()
    inventory = S.folder_inventory(S.list_files(spark, path), "b").collect()
    assert {(r["name"], r["selected"]) for r in inventory} == {("a/1 +é", False), ("b", True)}
    assert all(r["size"] > 0 for r in inventory)
    assert {tuple(r) for r in got} == {("a/1 +é", "x\ny", "é"), ("a/1 +é", "", "t"), ("b", "q", "new")}


def test_gate(spark):
    mb = 1024 * 1024
    df = spark.createDataFrame([
        ("ok.jsonl", 5), ("a b.jsonl", 100 * mb), ("a?b.jsonl", 1), ("big.jsonl", 100 * mb + 1),
        ("x.json", 1), ("X.JSONL", 1), (None, 1),
    ], "name string, size bigint")
    accepted, rejected = S.gate_files(df, 100 * 1024 * 1024)
    assert {(r["name"], r["safe_name"], r["collides"]) for r in accepted.collect()} == {
        ("ok.jsonl", "ok.jsonl", False), ("a b.jsonl", "a_b.jsonl", True),
        ("a?b.jsonl", "a_b.jsonl", True)}
    assert {(r["name"], r["error_message"]) for r in rejected.collect()} == {
        ("big.jsonl", "File too large"), ("x.json", "Only .jsonl files are allowed"),
        ("X.JSONL", "Only .jsonl files are allowed"), (None, "No file uploaded")}


def test_inventory(spark, tmp_path):
    data, models = tmp_path / "data", tmp_path / "models"
    data.mkdir(), models.mkdir()
    (data / "val.jsonl").write_text("{}")
    (data / "other.jsonl").write_text("{}\n{}")
    (data / "notes.txt").write_text("no")
    (models / "m-q8_0.gguf").write_text("12345")
    (models / "m-q8_0-report.json").write_text("{}")
    got = S.file_inventory(spark, [str(data)], [str(models)], "../data/val.jsonl")
    assert {(r["kind"], r["name"], r["size"], r["selected"], r["url"]) for r in got.collect()} == {
        ("dataset", "val.jsonl", 2, True, None), ("dataset", "other.jsonl", 5, False, None),
        ("artifact", "m-q8_0.gguf", 5, None, "/models/m-q8_0.gguf"),
        ("artifact", "m-q8_0-report.json", 2, None, "/models/m-q8_0-report.json")}
    plan = S.list_files(spark, str(data))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_folders_are_listed_by_tasks(spark, tmp_path):
    want = {}
    for i in range(300):
        folder = tmp_path / f"k={i % 70}" / "x y%2F" / str(i % 7)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i} é.{'json' if i % 2 else 'gguf'}").write_text("x" * i)
        (folder / ".hidden.json").write_text("x")
        (folder / f"{i}.txt").write_text("x")
        want[f"{i} é.{'json' if i % 2 else 'gguf'}"] = i
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "1.json").write_text("x")
    (tmp_path / "top.json").write_text("xy")
    want["top.json"] = 2
    found = S.list_files(spark, str(tmp_path), "*.{gguf,json}")
    assert {r["name"]: r["size"] for r in found.collect()} == want and found.count() == len(want)
    # The same as Spark's own listing, for addresses, sizes and times; that one passes over empty files.
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gguf,json}").load(str(tmp_path))
    columns = ("path", "size", F.unix_millis("modified").alias("ms"))
    own = own.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("ms"))
    assert {tuple(r) for r in found.filter("size > 0").select(*columns).collect()} == {tuple(r) for r in own.collect()}
    assert found.rdd.getNumPartitions() == 71
    assert S.list_files(spark, str(tmp_path / "k=[12]" / "*")).count() > 0
    assert {r["name"] for r in S.list_files(spark, str(tmp_path / "top.json")).collect()} == {"top.json"}
    with pytest.raises(FileNotFoundError):
        S.list_files(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert S.list_files(spark, str(tmp_path / "empty")).count() == 0


def test_inventory_sees_no_contents(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}")
    os.chmod(tmp_path / "a.jsonl", 0)
    assert S.dataset_inventory(S.list_files(spark, str(tmp_path))).select("size").collect()[0][0] == 2


def test_inspect(spark, tmp_path):
    df = spark.createDataFrame([("d", 2, "b", None), ("d", 1, "a", "x"), ("e", 5, "c", "y")],
                               "dataset string, seq int, input string, more string")
    row = T.inspect(df).first()
    assert row["schema"] == df.columns and set(json.loads(row["sample"])) == set(df.columns)
    each = {r["dataset"]: json.loads(r["sample"]) for r in T.inspect_each(df, ["dataset"], "seq").collect()}
    assert each["d"]["input"] == "a" and each["e"]["more"] == "y"
    T.write_report(df.limit(1), df, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/samples")).count() == 3
    assert spark.read.json(str(tmp_path / "report/summary-json")).count() == 1


def test_lines_are_numbered_across_files_written_by_many_tasks(spark, tmp_path):
    from pathlib import Path

    from pairworks.plans.shared import shared_dir
    from pairworks.suite.queries import line_numbers

    spark.range(4000).selectExpr("id AS doc_id", "concat('src', id % 3) AS source", "'en' AS lang", "repeat('x', 2000) AS text").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = line_numbers(spark, str(tmp_path))
        got = sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for k in range(3):
        ids = [i for i in range(4000) if i % 3 == k]
        want += [(f"src{k}", at, len(ids), i) for at, i in enumerate(ids, 1)]
    assert got == want
    # No task has written, and so none has read, the whole of a dataset.
    written = max((p for kind in ("ordered", "jsonl") for p in Path(shared_dir(spark).removeprefix("file://")).glob(f"pairworks/{kind}-*/dataset=src0")), key=lambda p: p.stat().st_mtime)
    assert len(list(written.glob("*.json"))) > 1

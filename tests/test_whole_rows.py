"""No row may vanish: ids and orders that are missing, and splits that change between plan and run."""

import json

import pytest
from pyspark.errors import PySparkException

from pairworks.operators.catalog import search_limit
from pairworks.operators.clean import clean, dedupe_pairs
from pairworks.operators.prepare import split_pairs
from pairworks.sources.lines import read_pairs_jsonl, with_line_no
from pairworks.streaming.batches import BatchTable


def plain_files(path, files=3, lines=20_000):
    for f in range(files):
        with open(path / f"f{f}.jsonl", "w") as out:
            out.writelines(json.dumps({"input": f"q{f}", "target": f"line {i}"}) + "\n" for i in range(lines))


def test_line_numbers_hold_when_the_cores_change(spark, tmp_path):
    plain_files(tmp_path)
    name = "spark.sql.leafNodeDefaultParallelism"
    try:
        for before, after in ((2, 16), (16, 2)):
            spark.conf.set(name, before)
            numbered = with_line_no(spark, str(tmp_path))
            spark.conf.set(name, after)
            rows = numbered.collect()
            assert len(rows) == 60_000
            assert all(json.loads(r.value)["target"] == f"line {r.line_no - 1}" for r in rows)
    finally:
        spark.conf.unset(name)


def test_plain_files_go_all_the_way(spark, tmp_path):
    plain_files(tmp_path, lines=50)
    rows, rejects = read_pairs_jsonl(spark, str(tmp_path), identified=True)
    assert rejects.count() == 0
    cleaned = clean(rows)
    assert cleaned.count() == 150 and cleaned.filter("target IS NULL OR sample_id IS NULL").count() == 0
    assert split_pairs(cleaned, 0.1).filter("split = 'validation'").count() == 15


def test_rows_without_an_order_keep_their_texts(spark):
    df = spark.createDataFrame([("d", None, "a", "x"), ("d", None, "a", "x"), ("d", 3, "b", "y"), ("d", None, "b", "y")],
                               "dataset string, sample_id bigint, input string, target string")
    assert sorted(map(tuple, dedupe_pairs(df).collect()), key=str) == [("d", 3, "b", "y"), ("d", None, "a", "x")]


def test_rows_without_an_id_fail_a_split(spark):
    df = spark.createDataFrame([("d", 1, "a", "x"), ("d", None, "b", "y")], "dataset string, sample_id bigint, input string, target string")
    with pytest.raises(PySparkException, match="a row has no sample_id"):
        split_pairs(df, 0.5).collect()


def test_a_half_written_micro_batch_is_not_read(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "version=5/t"), "a int", "a")
    assert table.latest().count() == 0
    table.put(0, spark.createDataFrame([(1,), (2,)], "a int"))
    # What tasks have written before the job is committed.
    spark.createDataFrame([(9,)], "a int").write.parquet(f"{table.path}/batch=1/_temporary/0/task")
    assert table.latest().count() == 2
    touched = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    table.put(1, spark.createDataFrame([(3,)], "a int"), touched)
    table.put(1, spark.createDataFrame([(3,)], "a int"), touched)
    assert [r.a for r in table.latest().collect()] == [3]
    assert table.before(1).count() == 2


def test_limits_are_read_like_numbers_at_the_start():
    assert [search_limit(v) for v in ("12ab", "7.9", " 5 ", "ab", 7, "250")] == [12, 7, 5, 20, 7, 20]
    assert search_limit("250", None) == 250

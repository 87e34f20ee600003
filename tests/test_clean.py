import random

from pairworks.operators import clean as C

SCHEMA = "sample_id bigint, dataset string, input string, target string, extra string"


def test_golden_rows(spark):
    df = spark.createDataFrame([
        (3, "d", "a", "b", "later"), (1, "d", "a", "b", "first"), (2, "d", "a ", "b", "untrimmed"),
        (4, "d", "  ", "b", "blank"), (5, "d", "a", None, "null"), (6, "d", " ", "b", "nbsp"),
        (7, "e", "a", "b", "other"), (8, "d", "12", "3", "numbers"), (9, None, "a", "b", "no set"),
    ], SCHEMA)
    assert {(r["sample_id"], r["extra"]) for r in C.clean(df).collect()} == {
        (1, "first"), (2, "untrimmed"), (7, "other"), (8, "numbers"), (9, "no set")}
    stats = {r["dataset"]: (r["initial"], r["removed"], r["count"]) for r in C.clean_stats(df).collect()}
    assert stats == {"d": (7, 4, 3), "e": (1, 0, 1), None: (1, 0, 1)}


def test_random_rows_keep_first_and_idempotence(spark, tmp_path):
    rng = random.Random(5)
    texts = ["", " ", "x", "x ", "y", None]
    rows = [(i, rng.choice("de"), rng.choice(texts), rng.choice(texts), str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    first = {}
    for row in rows:
        first.setdefault(row[1:4], row)
    want = {r for r in first.values() if (r[2] or "").strip() and (r[3] or "").strip()}
    written = C.write_clean(df, str(tmp_path / "pairs"), "1")
    assert {tuple(r) for r in written.collect()} == want
    assert {tuple(r) for r in C.clean(written).collect()} == want
    deduped = {tuple(r) for r in C.dedupe_pairs(df).collect()}
    assert deduped == set(first.values())
    assert {tuple(r) for r in C.dedupe_pairs(df, keys=()).collect()} <= deduped


def test_no_text_is_sorted_or_shuffled(spark):
    df = spark.range(10).selectExpr("id AS sample_id", "'d' AS dataset", "concat('a', id % 3) AS input", "'b' AS target")
    cleaned = C.clean(df)
    assert sorted(r["sample_id"] for r in cleaned.collect()) == [0, 1, 2]
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort " not in plan and "hashpartitioning" not in plan


def test_tied_and_missing_orders_keep_one_copy(spark):
    rows = [(None, "d", "a", "b", "x"), (None, "d", "a", "b", "y"), (4, "d", "c", "b", "x"), (4, "d", "c", "b", "y"),
            (4, "d", "e", "b", "z"), (None, "d", "e", "b", "w"), (None, None, "a", "b", "v"), (7, None, "a", "b", "u")]
    got = C.dedupe_pairs(spark.createDataFrame(rows, SCHEMA)).select("sample_id", "dataset", "input").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, "d", "a"), (4, "d", "c"), (4, "d", "e"), (7, None, "a")], key=str)

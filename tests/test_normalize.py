import json

import pytest

from pairworks.operators import normalize as N

SHAPES = [
    # columns, row, (input, target)
    ({"instruction": "do", "input": "this", "output": "done"}, ("do\nthis", "done")),
    ({"instruction": "do", "input": "", "output": "done"}, ("do", "done")),
    ({"instruction": "", "input": "this", "output": "done"}, ("this", "done")),
    ({"input": "", "prompt": "p", "response": "r"}, ("p", "r")),
    ({"act": "a pirate", "prompt": "Arr"}, ("Act as a pirate", "Arr")),
    ({"prompt": "p", "response": "r"}, ("p", "r")),
    ({"input": "i", "target": "t", "output": "o"}, ("i", "t")),
    ({"input": "i", "target": "", "output": "o"}, ("i", "")),
    ({"input": " i \n", "target": "﻿t "}, ("i", "﻿t")),
    ({"instruction": "", "act": "x", "prompt": "p"}, ("", "p")),
    ({"other": "x"}, ("", "")),
]


@pytest.mark.parametrize("row,want", SHAPES)
def test_mapping_by_columns_and_by_json(spark, row, want):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    assert tuple(N.normalize_pairs(df, keep=[]).first()) == want
    text = spark.createDataFrame([(json.dumps(row),)], "raw string")
    assert tuple(N.normalize_json(text, "raw", []).first()) == want


def test_types_and_nulls(spark):
    df = spark.sql("""SELECT * FROM VALUES (0, true, 1.5D), (7, false, null), (null, null, 2.0D)
                      AS t(input, instruction, target)""")
    got = {tuple(r) for r in N.normalize_pairs(df).collect()}
    assert got == {("True", "1.5"), ("7", ""), ("", "2.0")}
    rows = ['{"input": 0, "prompt": "p", "target": 5}', '{"input": false, "act": "x", "target": true}',
            '{"input": [], "instruction": "i", "target": null}', '{"input": [1], "target": "t"}', "broken"]
    text = spark.createDataFrame(list(enumerate(rows)), "n int, raw string")
    got = {r["n"]: (r["input"], r["target"]) for r in N.normalize_json(text, "raw", ["n"]).collect()}
    assert got == {0: ("p", "5"), 1: ("Act as x", "True"), 2: ("i", ""), 3: ("[1]", "t"), 4: ("", "")}


def test_validity_and_counts(spark):
    df = spark.createDataFrame(
        [("d", "a", "b"), ("d", "", "b"), ("d", None, "b"), ("d", "a", ""), ("e", "x", None)],
        "dataset string, input string, target string")
    assert N.keep_valid(df).count() == 1
    got = {(r["dataset"], r["count"], r["skipped"]) for r in N.import_stats(df, ["dataset"]).collect()}
    assert got == {("d", 1, 3), ("e", 0, 1)}


def test_row_transforms(spark):
    df = spark.createDataFrame(
        [(1, "q", "2", 2**60 + 1), (2, "r", "x", 5), (3, None, "4", None)], "n int, a string, b string, c bigint")
    made = N.transform_sql(df, "upper(a)", "b || '!'", ["n"]).collect()
    assert {tuple(r) for r in made} == {(1, "Q", "2!"), (2, "R", "x!"), (3, None, "4!")}

    def transform(row):
        if row["a"] is None:
            return None
        assert row["c"] in (2**60 + 1, 5)
        return {"input": row["a"], "target": 2 * int(row["b"])}

    rows = {r["n"]: r for r in N.transform_rows(df, transform, ["n"]).collect()}
    assert (rows[1]["input"], rows[1]["target"], rows[1]["error"]) == ("q", "4", None)
    assert rows[2]["error"].startswith("ValueError") and rows[2]["input"] is None
    assert rows[3]["input"] is None and rows[3]["error"] is None


@pytest.mark.parametrize("chunk", [2, 1000])
def test_chat_pairs(spark, chunk):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"),
            (1, 4, "user", "u2"), (1, 7, "assistant", "a2"), (1, 8, "assistant", "a3"),
            (2, 0, "assistant", "x"), (2, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {tuple(r) for r in N.chat_to_pairs(df, chunk=chunk).collect()}
    assert got == {(1, 2, "User: u1 \n", "a1"), (1, 7, "User: u2 \n", "a2")}

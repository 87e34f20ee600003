import pytest
from pyspark.sql import functions as F

from pairworks.operators import evaluate as E
from pairworks.operators.prepare import prompt
from pairworks.sources.lines import parse_pairs, with_line_no


@pytest.mark.parametrize("limit", [0.0, 0.001, 0.5, 1.0, 2.0])
@pytest.mark.parametrize("chunk", [4, 1000])
def test_head_of_every_dataset(spark, limit, chunk):
    rows = [(k, 3 * i) for k, n in (("a", 1), ("b", 3), ("c", 100), (None, 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, at bigint")
    got = {tuple(r) for r in E.head_fraction(df, limit, ("dataset",), "at", chunk).collect()}
    want = set()
    for k, n in (("a", 1), ("b", 3), ("c", 100), (None, 10)):
        take = max(1, int(n * limit)) if 0 < limit < 1 else n
        want |= {(k, 3 * i) for i in range(take)}
    assert got == want


def test_head_of_files_counts_every_line(spark, tmp_path):
    lines = ['{"input": "1", "target": "x"}', "", "broken", '{"input": "2", "target": "y"}', "", "", "", ""]
    (tmp_path / "val.jsonl").write_text("\n".join(lines) + "\n")
    head = E.head_lines(with_line_no(spark, str(tmp_path)), 0.5)
    rows, rejects = parse_pairs(head)
    assert [r["input"] for r in rows.orderBy("line_no").collect()] == ["1", "2"]
    assert rejects.count() == 1
    assert E.head_lines(with_line_no(spark, str(tmp_path)), 0.01).count() == 1


def test_limit_comes_before_the_model(spark):
    df = spark.range(100).selectExpr("id AS at", "id % 3 AS dataset")
    head = E.head_fraction(df, 0.2, ("dataset",), "at")

    def keep(frames):
        yield from frames

    plan = head.mapInPandas(keep, head.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Filter")


def test_predictions(spark):
    df = spark.createDataFrame([
        (1, " yes Input: more", "yes", None), (2, "\nanswer", "answer", None), (3, "", None, None),
        (4, "yes", "yes ", None), (5, "a\nInput:", "a", None), (6, None, "x", "timeout"),
        (7, "Input:\nx", "", None),
    ], "n int, reply string, target string, error string")
    got = {r["n"]: (r["output"], r["correct"]) for r in E.score_exact(df).collect()}
    assert got == {1: ("yes", True), 2: ("", False), 3: ("", True), 4: ("yes", False), 5: ("a", True),
                   6: (None, None), 7: ("", True)}
    assert spark.createDataFrame([("q",)], "input string").select(prompt(F.col("input"))).first()[0] == \
        "Input: q\nOutput:"


def test_accuracy(spark):
    scored = spark.createDataFrame(
        [("m", "f16", True), ("m", "f16", False), ("m", "f16", None), ("m", "q8_0", None)],
        "model string, quantization string, correct boolean")
    runs = spark.createDataFrame([("m", "f16"), ("m", "q8_0"), ("n", "f16")], "model string, quantization string")
    rejects = spark.createDataFrame([("m", "f16"), ("n", "f16"), ("n", "f16")], "model string, quantization string")
    got = {tuple(r) for r in E.accuracy_report(scored, runs, rejects).collect()}
    assert got == {("m", "f16", 0.5, 2, 1, 1), ("m", "q8_0", 0.0, 0, 0, 0), ("n", "f16", 0.0, 0, 0, 2)}
    assert E.accuracy_report(scored).count() == 2
    assert {r["skipped"] for r in E.accuracy_report(scored, rejects=rejects).collect()} == {0, 1, 2}


def test_judge_prompts(spark):
    df = spark.createDataFrame(
        [(s, "i{x}", "t", "o") for s in (0, 29, 30, 70, 71)],
        "sharpness int, input string, target string, output string")
    got = {r["sharpness"]: r["prompt"] for r in E.judge_prompts(df).collect()}
    kind = {s: next(w for w in ("lenient", "balanced", "strict") if f"{w} judge" in p) for s, p in got.items()}
    assert kind == {0: "lenient", 29: "lenient", 30: "balanced", 70: "balanced", 71: "strict"}
    assert 'Input Prompt: "i{x}"' in got[0] and '{"score": <number>, "reason": "<short explanation>"}' in got[0]


def test_judgments_and_report(spark):
    replies = [('```json\n{"score": 8, "reason": "ok"}\n```', 8.0, "ok", False, False),
               ('{"score": 7.5, "reason": "fine"}', 7.5, "fine", False, False),
               ("I think 9", 0.0, "Judge Failed", True, False), ('{"reason": "x"}', 0.0, "Judge Failed", True, False),
               ('{"score": "9"}', 0.0, "Judge Failed", True, False), ('{"score": 12}', 12.0, None, False, True),
               (None, 0.0, "Judge Failed", True, False), ('{"score": 3} extra', 0.0, "Judge Failed", True, False)]
    df = spark.createDataFrame(
        [(i, "m", "f16", 50, r[0]) for i, r in enumerate(replies)],
        "n int, model string, quantization string, sharpness int, reply string")
    judged = E.parse_judgments(df)
    got = {r["n"]: (r["score"], r["reason"], r["failed"], r["out_of_range"]) for r in judged.collect()}
    assert got == {i: r[1:] for i, r in enumerate(replies)}
    accuracy = spark.createDataFrame([("m", "f16", 0.25)], "model string, quantization string, accuracy double")
    report = E.judge_report(judged, accuracy).first()
    assert report["average_score"] == pytest.approx(27.5 / 8) and report["static_accuracy"] == 0.25
    assert report["sharpness"] == 50


def test_choice_of_test_set(spark):
    files = spark.createDataFrame(
        [("a", "a/val.jsonl", "val.jsonl"), ("a", "a/dataset.jsonl", "dataset.jsonl"),
         ("b", "b/dataset.jsonl", "dataset.jsonl"), ("c", "c/x.jsonl", "x.jsonl")],
        "folder string, path string, name string")
    got = {tuple(r) for r in E.choose_test_set(files, ("folder",)).collect()}
    assert got == {("a", "a/val.jsonl"), ("b", "b/dataset.jsonl")}
    assert E.choose_test_set(files.filter("folder = 'c'")).count() == 0

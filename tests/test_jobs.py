import pytest
from pyspark.sql import functions as F

from pairworks.operators import jobs as J
from pairworks.operators.prepare import WhitespaceTokenizer
from pairworks.sources.lines import read_pairs_jsonl, with_line_no


def test_import(spark, tmp_path):
    raw = spark.createDataFrame(
        [("i", "a", "b"), ("", "a", ""), ("", " ", "b"), (None, "c", "d")],
        "instruction string, input string, output string").repartition(3)
    told = J.import_dataset(raw, "own/repo", str(tmp_path))
    assert told == {"filename": "own_repo.jsonl", "count": 2, "skipped": 2}
    rows, _ = read_pairs_jsonl(spark, str(tmp_path / "own_repo.jsonl"))
    assert {(r["input"], r["target"]) for r in rows.collect()} == {("i\na", "b"), ("c", "d")}

    def transform(row):
        return {"input": row["input"].upper(), "target": row["output"]} if row["instruction"] else 1 / 0

    told = J.import_dataset(raw, "own/other", str(tmp_path), transform)
    assert (told["count"], told["skipped"]) == (1, 3)


def test_training_input(spark):
    pairs = spark.range(50).select(
        F.lit("d").alias("dataset"), F.col("id").alias("sample_id"),
        F.concat(F.lit("q"), "id").alias("input"), F.lit("a b").alias("target"))
    batches, held_out = J.training_input(pairs, 0.1, 8, WhitespaceTokenizer())
    ids = [i for r in batches.collect() for i in r["sample_ids"]]
    assert held_out.count() == 5 and len(ids) == 45
    assert not set(ids) & {r["sample_id"] for r in held_out.collect()}


def test_training_job_publishes_both_outputs_of_one_split(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    pairs = lambda n: spark.range(n).select(
        F.lit("d").alias("dataset"), F.col("id").alias("sample_id"), F.concat(F.lit("q"), "id").alias("input"), F.lit("a b").alias("target"))

    def outputs():
        batches, held = J.published_run(spark, folder)
        rows, _ = read_pairs_jsonl(spark, f"{held}/*/*.json")
        return sorted(f"q{i}" for r in spark.read.parquet(batches).collect() for i in r["sample_ids"]), sorted(r["input"] for r in rows.collect())

    assert J.published_run(spark, folder) is None
    told = J.training_job(pairs(50), 0.1, 8, WhitespaceTokenizer(), folder)
    train, held = outputs()
    assert (told["train"], told["validation"], len(train), len(held)) == (45, 5, 45, 5)
    assert sorted(train + held) == sorted(f"q{i}" for i in range(50))
    # A run that breaks off between its outputs leaves the one before.
    with monkeypatch.context() as broken:
        broken.setattr(J, "write_pairs_jsonl", lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            J.training_job(pairs(70), 0.1, 8, WhitespaceTokenizer(), folder)
    assert outputs() == (train, held)
    J.training_job(pairs(70), 0.1, 8, WhitespaceTokenizer(), folder)
    assert [len(x) for x in outputs()] == [63, 7]
    with pytest.raises(ValueError, match="empty"):
        J.training_job(pairs(0), 0.1, 8, WhitespaceTokenizer(), folder)


def test_generated_dataset_is_written_and_counted(spark, tmp_path):
    import datetime

    def client():
        def call(prompt, temperature, timeout):
            return '[{"input": "x", "target": "y"}, {"input": "z"}]' if "good" in prompt else "no"
        return call

    seeds = spark.createDataFrame(
        [(1, "good", "o", 2), (2, "bad", "o", 2), (3, "", "o", 2), (4, "good", "p", 99)],
        "n int, seed_input string, seed_output string, count int")
    made = datetime.datetime(2024, 1, 2, 3, 4, 5, 67_000)
    told, rejects = J.generate_job(seeds, ["n"], client, str(tmp_path), made=made, path=str(tmp_path / "ledger"))
    assert told == {"filename": "generated_2024-01-02T03-04-05-067Z.jsonl", "count": 4}
    rows, _ = read_pairs_jsonl(spark, str(tmp_path / told["filename"]))
    assert sorted((r["input"], r["target"] or "") for r in rows.collect()) == [("x", "y"), ("x", "y"), ("z", ""), ("z", "")]
    assert {(r["n"], r["error_code"]) for r in rejects.collect()} == {(2, "INTERNAL_ERROR"), (3, "INVALID_INPUT")}


def test_generation(spark):
    def client():
        def call(prompt, temperature, timeout):
            assert temperature == 0.8
            return '[{"input": "x", "target": "y"}]' if "good" in prompt else "no"
        return call

    seeds = spark.createDataFrame(
        [(1, "good", "o", 2), (2, "bad", "o", 2), (3, "", "o", 2)],
        "n int, seed_input string, seed_output string, count int")
    rows, rejects = J.generate_variations(seeds, ["n"], client)
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "x", "y")]
    assert {(r["n"], r["error_code"]) for r in rejects.collect()} == {(2, "INTERNAL_ERROR"), (3, "INVALID_INPUT")}


def test_evaluation_and_judging(spark, tmp_path):
    lines = ['{"input": "a", "target": "A"}', '{"input": "b", "target": "no"}', "broken",
             '{"input": "fail", "target": "x"}', '{"input": "", "target": ""}', '{"input": "c", "target": "C"}']
    (tmp_path / "val.jsonl").write_text("\n".join(lines) + "\n")

    def model():
        def call(prompt, temperature, timeout):
            if "fail" in prompt:
                raise RuntimeError("down")
            return prompt.removeprefix("Input: ").removesuffix("\nOutput:").upper()
        return call

    def judge():
        def call(prompt, temperature, timeout):
            assert "strict judge" in prompt
            return '{"score": 4}' if 'Output: "A"' in prompt else "?"
        return call

    numbered = with_line_no(spark, str(tmp_path))
    report, samples = J.evaluate_model(numbered, "m", "f16", model)
    assert tuple(report.first()) == ("m", "f16", 0.75, 4, 3, 1)
    assert {(r["line_no"], r["correct"]) for r in samples.collect()} == {(1, True), (2, False), (5, True), (6, True)}
    verdict, judged = J.judge_model(samples, report, judge, limit=1.0, sharpness=90)
    row = verdict.first()
    assert (row["average_score"], row["static_accuracy"], row["sharpness"], row["limit"]) == (1.0, 0.75, 90, 1.0)
    assert judged.count() == 4
    half, _ = J.evaluate_model(numbered, "m", "f16", model, limit=0.5)
    assert (half.first()["total"], half.first()["skipped"]) == (2, 1)
    with pytest.raises(ValueError, match="No samples"):
        J.judge_model(samples.filter("false"), report, judge)

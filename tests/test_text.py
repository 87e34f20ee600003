import random
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed
from pairworks.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_python_strip_agrees_with_python(spark):
    texts = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3100)] + ["﻿a﻿", "", "   "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", X.py_strip(F.col("t")).alias("s")).collect()
    assert [r for r in rows if r["s"] != r["t"].strip()] == []


def test_javascript_whitespace(spark):
    assert one(spark, X.js_collapse, "﻿ a  \t b c ") == "a b c"
    assert one(spark, X.js_trim, "\x1ca\x1c") == "\x1ca\x1c"


def test_fences_go_anywhere(spark):
    assert one(spark, X.strip_fences, '```json\n{"a": "```"}\n```') == '{"a": ""}'
    assert one(spark, X.strip_fences, "```python\nx = 1\n```\n") == "x = 1"


def test_names_and_log_text(spark):
    assert one(spark, X.safe_file_name, "my file (é).jsonl") == "my_file____.jsonl"
    assert one(spark, X.base_name, "a/b/c.gguf") == "c.gguf"
    assert one(spark, lambda c: X.sanitize_for_log(c, 500), "a\r\nb" + "x" * 600) == "a  b" + "x" * 496
    assert one(spark, X.sanitize_for_log, "a\n" + "x" * 600) == "a " + "x" * 600
    assert X.repo_file_name("owner/name") == "owner_name.jsonl"


@pytest.mark.parametrize("value,whole,real", [
    ("12ab", 12, 12.0), (" -7.5x", -7, -7.5), ("abc", None, None), (".5", None, 0.5),
    ("1e3", 1, 1000.0), ("", None, None),
])
def test_number_prefixes(spark, value, whole, real):
    assert one(spark, X.parse_int, value) == whole
    assert one(spark, X.parse_float, value) == real


def test_exponents(spark):
    df = spark.createDataFrame([(0.00005,), (123456.0,), (1.5e-12,)], "t double")
    assert [r[0] for r in df.select(X.to_exponential(F.col("t"), 2)).collect()] == [
        "5.00e-5", "1.23e+5", "1.50e-12"]


def test_fixed_decimals_round_the_exact_value(spark):
    rng = random.Random(2)
    values = [0.125, 0.375, -0.625, 1.005, 1.115, 2.5, 8.345, 0.0, 1234567.891, -0.004, 1e-9]
    values += [rng.randint(-10**6, 10**6) / 2 ** rng.randint(0, 12) for _ in range(200)]
    values += [round(rng.uniform(-100, 100), 3) for _ in range(300)]
    for digits in (2, 4):
        got = spark.createDataFrame([(v,) for v in values], "t double").select(
            "t", X.to_fixed(F.col("t"), digits).alias("s")).collect()
        for r in got:
            want = Decimal(r["t"]).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
            assert Decimal(r["s"]) == want and len(r["s"].split(".")[1]) == digits


def test_file_names(spark):
    made = datetime(2024, 5, 6, 7, 8, 9, 123000, tzinfo=timezone.utc)
    df = spark.createDataFrame([(made, "tuned", "f16")], "made timestamp, model string, quantization string")
    assert tuple(df.select(
        X.generated_file_name(F.col("made")), X.report_file_name(F.col("model"), F.col("quantization"), "judge"),
    ).first()) == ("generated_2024-05-06T07-08-09-123Z.jsonl", "tuned-f16-judge.json")


def test_digest_frames_texts(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("abc", None), ("abc", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(X.digest(F.col("a"), F.col("b"))).distinct().count() == len(rows)


def test_template_fields(spark):
    filled = spark.createDataFrame([("{x}",)], "t string").select(
        X.fill(fixed.PROMPT_TEMPLATE, input=F.col("t"))).first()[0]
    assert filled == "Input: {x}\nOutput:"


def test_json_must_be_one_whole_value(spark):
    good = ['{"a":1}', ' {"a":[1]} ', "[1,2]", "5", "null", '"x"', '{"a":"]}"}', '{"a":1,"a":2}']
    bad = ["", '{"a":1} x', '{"a":1}}', '{"a":1}]', '{"a":1},', '{"a":1},{"b":2}', '{"a":1}]}', "5 6",
           '{"a":1}}]', '{"a":1}] {}', '{"a":1},0]', "{'a':1}", '{"a":NaN}', "x"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = X.with_json(df, "v", F.col("t")).select("t", F.col("v").isNotNull().alias("ok")).collect()
    assert len(got) == len(good + bad) and [r["t"] for r in got if r["ok"]] == good


def test_long_json_is_one_whole_value(spark):
    text = lambda n: F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), F.col("id").cast("int") + n), F.lit('"}'))
    for n in (30_000_000,):
        for value, ok in ((text(n), True), (F.concat(text(n), F.lit("x")), False), (F.concat(F.lit('{"b":NaN,"c":'), text(n), F.lit("}")), False)):
            got = X.with_json(spark.range(1).select(value.alias("t")), "v", F.col("t"))
            assert got.select(F.length(F.try_variant_get("v", "$.a", "string"))).first()[0] == (n if ok else None)
    beyond = spark.range(1).select(text(140_000_000).alias("t"))
    with pytest.raises(Exception, match="more than 128 MiB"):
        X.with_json(beyond, "v", F.col("t")).select(F.col("v").isNull()).collect()

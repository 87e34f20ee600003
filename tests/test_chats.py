import json

from pyspark.sql import functions as F

from pairworks.operators import chats
from pairworks.operators import rules as R
from pairworks.operators.completion import ModelError

SCHEMA = "conv_id bigint, messages array<struct<role: string, content: string>>, envelope string"


def model(calls):
    refusal = ModelError

    def client():
        def call(prompt, temperature, timeout):
            messages = json.loads(prompt)
            with calls.open("a") as log:
                log.write(messages[-1].get("content", "none") + "\n")
            if messages[-1].get("content") == "busy":
                raise refusal(503, "later")
            if messages[-1].get("content") == "broken":
                raise ValueError("what")
            return f"{len(messages)} messages"
        return call
    return client


def test_chats_are_answered_to_the_end(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.touch()
    made = spark.createDataFrame(
        [(1, "r", "hello", ("exact", True, False), "hi there", None, None, True), (2, "x", "^ab+", ("regex", False, False), "abc", None, None, True)],
        R.RULE_SCHEMA)
    rows = [(1, [("user", "HELLO")], "e"), (2, [("system", "s"), ("user", "what?")], "e"), (3, [("user", "busy")], "e"), (4, [], "e"), (5, None, "e"),
            (6, [("user", "broken")], "e"), (7, [("user", "abb")], "e"), (None, [("user", "what?")], "e"), (None, [("user", "hello")], "e"),
            (2, [("system", "s"), ("user", "what?")], "e"), (8, [("user", None)], "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda some: chats.answer_chats(some, made, model(calls), path=str(tmp_path / "ledger"))
    text = F.col("envelope.choices")[0]["message"]["content"]
    got = run(df.repartition(3)).select("conv_id", "route", "matched_id", "status", text, "envelope.id", "envelope.model", "error.message").collect()
    up, rule = "upstream", "override-rules"
    no = "Invalid messages"
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, "rule", "r", 200, "hi there", "chatcmpl-1", rule, None), (2, up, None, 200, "2 messages", "chatcmpl-2", up, None),
        (2, up, None, 200, "2 messages", "chatcmpl-2", up, None), (3, up, None, 503, None, None, None, "ModelError: model API returned 503: later"),
        (4, "rejected", None, 400, None, None, None, no), (5, "rejected", None, 400, None, None, None, no),
        (6, up, None, 500, None, None, None, "ValueError: what"), (7, "rule", "x", 200, "abc", "chatcmpl-7", rule, None),
        (None, up, None, 200, "1 messages", None, up, None), (None, "rule", "r", 200, "hi there", None, rule, None),
        (8, up, None, 200, "1 messages", "chatcmpl-8", up, None)], key=str)
    assert sorted(calls.read_text().split()) == ["broken", "busy", "none", "what?", "what?"]
    # Answered calls are not made again, failed ones are, and other rows may come.
    calls.write_text("")
    more = df.unionByName(spark.createDataFrame([(9, [("user", "new")], "e")], SCHEMA)).repartition(5)
    assert run(more).filter("status = 200").count() == 8
    assert sorted(calls.read_text().split()) == ["broken", "busy", "new"]


def test_no_chats(spark, tmp_path):
    calls = tmp_path / "calls"
    none = chats.answer_chats(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], R.RULE_SCHEMA), model(calls))
    assert none.count() == 0 and not calls.exists()

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pairworks.functions.patterns import required_literals
from pairworks.operators import rules as R

T0 = datetime(2024, 1, 1)
EMPTY_RULES: list = []


def replay(changes):
    """The log gone through one change at a time."""
    rules, rejects = [], []
    for seq, ts, op, id_, body in changes:
        body = dict(body or {})
        if op == "POST":
            rules.append({**body, "id": id_, "rule_ord": seq, "created_at": ts, "updated_at": ts})
            continue
        if op == "PUT" and body.get("id", id_) != id_ or op not in ("PUT", "DELETE"):
            rejects.append((seq, "INVALID_INPUT"))
            continue
        at = next((i for i, r in enumerate(rules) if r["id"] == id_), None)
        if at is None:
            rejects.append((seq, "NOT_FOUND"))
        elif op == "PUT":
            rules[at] = {**rules[at], **body, "id": id_, "updated_at": ts}
        else:
            rules.pop(at)
    return rules, rejects


def random_changes(seed, n=250):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = 10 * i + rng.randint(0, 9)
        op = rng.choices(["POST", "PUT", "DELETE", "PATCH"], [4, 4, 3, 0.2])[0]
        id_ = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c"])
        body = {k: v for k, v in {
            "trigger": f"t{i}", "response": f"r{i}", "enabled": rng.choice(["true", "false"]),
            "match": json.dumps({"type": rng.choice(["exact", "regex"]), "case_insensitive": True}),
        }.items() if op == "POST" or rng.random() < 0.4}
        if op == "PUT" and rng.random() < 0.1:
            body["id"] = rng.choice([id_, "stolen"])
        out.append((seq, T0 + timedelta(seconds=i), op, id_, body))
    return out


def rule_rows(df):
    return {(r["rule_ord"], r["id"], r["trigger"], r["response"], r["enabled"],
             r["match"]["type"] if r["match"] else None, r["created_at"], r["updated_at"])
            for r in df.collect()}


def want_rows(rules):
    return {(r["rule_ord"], r["id"], r.get("trigger"), r.get("response"), r.get("enabled") == "true",
             json.loads(r["match"])["type"] if "match" in r else None, r["created_at"], r["updated_at"])
            for r in rules}


@pytest.mark.parametrize("seed,chunk", [(1, 10_000), (2, 10), (3, 1)])
def test_change_log_equals_replay(spark, seed, chunk):
    changes = random_changes(seed)
    log = spark.createDataFrame(changes, R.CHANGE_SCHEMA).repartition(3)
    none = spark.createDataFrame([], R.RULE_SCHEMA)
    rules, rejects = R.apply_rule_changes(none, log, chunk)
    want, refused = replay(changes)
    assert rule_rows(rules) == want_rows(want)
    assert {(r["seq"], r["error_code"]) for r in rejects.collect()} == set(refused)


def test_change_log_in_two_parts(spark):
    changes = random_changes(7)
    first = spark.createDataFrame(changes[:130], R.CHANGE_SCHEMA)
    second = spark.createDataFrame(changes[130:], R.CHANGE_SCHEMA)
    none = spark.createDataFrame([], R.RULE_SCHEMA)
    rules, _ = R.apply_rule_changes(none, first)
    rules, _ = R.apply_rule_changes(rules, second)
    assert rule_rows(rules) == want_rows(replay(changes)[0])


def test_generated_ids_and_created_at(spark):
    log = spark.createDataFrame([
        (1, T0, "POST", None, {"trigger": "t", "enabled": "true"}),
        (2, T0, "POST", None, {"id": "mine", "trigger": "u"}),
        (3, T0 + timedelta(1), "PUT", "mine", {"createdAt": "2020-02-02T00:00:00Z", "trigger": None}),
    ], R.CHANGE_SCHEMA)
    rules, rejects = R.apply_rule_changes(spark.createDataFrame([], R.RULE_SCHEMA), log)
    got = {r["rule_ord"]: r for r in rules.collect()}
    assert len(got[1]["id"]) == 64 and got[1]["enabled"] and not got[2]["enabled"]
    assert got[2]["id"] == "mine" and got[2]["trigger"] is None
    assert got[2]["created_at"] == datetime(2020, 2, 2) and got[2]["updated_at"] == T0 + timedelta(1)
    assert rejects.count() == 0


def rule(ord_, trigger, kind="exact", ci=None, ws=None, enabled=True, response=None):
    return (ord_, f"id{ord_}", trigger, (kind, ci, ws), response or f"r{ord_}", T0, T0, enabled)


def loop(text, rules, empty=False):
    """First match, one rule after the other."""
    if text is None or (text == "" and not empty):
        return None
    for ord_, _, trigger, (kind, ci, ws), _, _, _, enabled in sorted(rules, key=lambda r: r[0]):
        if not enabled:
            continue
        mine, theirs = text, trigger
        if ws:
            mine, theirs = (re.sub(r"\s+", " ", t.strip()) for t in (mine, theirs))
        if ci:
            mine, theirs = mine.lower(), theirs.lower()
        if kind == "exact" and mine == theirs:
            return ord_
        if kind == "regex":
            try:
                if re.search(trigger, mine, re.I if ci else 0):
                    return ord_
            except re.error:
                pass
    return None


RULES = [
    rule(1, "off", enabled=False), rule(2, "Hello  World", ci=True, ws=True), rule(3, "meaning", "semantic"),
    rule(4, "[unclosed", "regex"), rule(5, "^hel+o", "regex"), rule(6, "hello there"),
    rule(7, "École", ci=True), rule(8, "éCOL", "regex", ci=True), rule(9, " Pad "), rule(10, "pad", ws=True),
    rule(11, "pad", ci=True, ws=True), rule(12, "x y", "regex", ws=True), rule(13, "off"),
    rule(14, "hello there"), rule(15, r"\d{3}", "regex"), rule(16, "   ", ws=True), rule(17, "Q.E", "regex"),
]
TEXTS = ["", None, "off", "hello world", " HELLO   world ", "hello there", "Hello", "hellllo", "meaning",
         "école", "ÉCOLES", " Pad ", "pad", " PAD", "x  \t y", "a 123 b", "nothing", "   ", "Q E", "q e", "[unclosed"]


@pytest.mark.parametrize("empty", [False, True])
def test_first_match_equals_a_loop(spark, empty):
    rules = spark.createDataFrame(RULES, R.RULE_SCHEMA).repartition(3)
    inputs = spark.createDataFrame(list(enumerate(TEXTS)), "n int, input string")
    got, rejects = R.resolve(inputs, rules, match_empty=empty)
    want = {(n, loop(t, RULES, empty)) for n, t in enumerate(TEXTS)}
    rows = got.collect()
    assert {(r["n"], r["matched_ord"]) for r in rows} == want
    assert all(r["response"] == (r["matched_ord"] and f"r{r['matched_ord']}") for r in rows)
    assert [r["rule_ord"] for r in rejects.collect()] == [4]


def test_random_rules_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(R, "REGEXES_PER_PASS", 4)
    rng = random.Random(11)
    alphabet = "abAB "
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    rules = [rule(i, word(rng.randint(1, 3)), rng.choice(["exact", "regex"]), rng.random() < 0.5,
                  rng.random() < 0.5, rng.random() < 0.8) for i in range(40)]
    texts = [word(rng.randint(0, 5)) for _ in range(300)]
    got, _ = R.resolve(
        spark.createDataFrame(list(enumerate(texts)), "n int, input string"),
        spark.createDataFrame(rules, R.RULE_SCHEMA))
    assert {(r["n"], r["matched_ord"]) for r in got.collect()} == {
        (n, loop(t, rules)) for n, t in enumerate(texts)}


def test_more_exact_rules_than_are_broadcast(spark, monkeypatch):
    """The way for many rules gives what the loop gives, also with a filter that is far too full."""
    rng = random.Random(8)
    words = ["Alpha", "alpha", "beta", " beta", "Gamma  x", "gamma x", "é", "É"]
    for most, bloom in ((0, 2_000_000), (3, 1)):
        rules = [rule(i, f"{rng.choice(words)}{rng.choice(['', rng.randrange(30)])}", ci=rng.random() < 0.5, ws=rng.random() < 0.5)
                 for i in range(60)] + RULES
        texts = [f"{rng.choice(words)}{rng.choice(['', rng.randrange(40)])}" for _ in range(200)] + TEXTS + ["alpha"] * 300
        monkeypatch.setattr(R, "RULES_TO_BROADCAST", most)
        monkeypatch.setattr(R, "BLOOM_WORDS", bloom)
        rows = spark.createDataFrame(list(enumerate(texts)), "n int, input string").repartition(3)
        got = {r["n"]: r["exact_ord"] for r in R.match_exact(rows, spark.createDataFrame(rules, R.RULE_SCHEMA)).collect()}
        exact = [r for r in rules if r[3][0] == "exact"]
        assert got == {n: loop(text, exact, empty=True) for n, text in enumerate(texts)}
    resolved, _ = R.resolve(rows, spark.createDataFrame(exact, R.RULE_SCHEMA))
    assert {r["n"]: r["response"] for r in resolved.collect()} == {
        n: None if not text or ord_ is None else f"r{ord_}" for n, text in enumerate(texts) for ord_ in [loop(text, exact)]}
    none = spark.createDataFrame([], "n int, input string")
    assert R.match_exact(none, spark.createDataFrame(rules, R.RULE_SCHEMA)).collect() == []


def test_ten_million_exact_rules(spark):
    """Texts go into no exchange, and the filter leaves few rows to look up."""
    rules = spark.range(10_000_000).selectExpr(
        "id AS rule_ord", "string(id) AS id", "concat('Trigger ', id) AS trigger",
        "named_struct('type', 'exact', 'case_insensitive', id % 2 = 0, 'normalize_ws', false) AS match", "'r' AS response",
        "CAST(NULL AS timestamp) AS created_at", "CAST(NULL AS timestamp) AS updated_at", "true AS enabled")
    texts = spark.range(40_000).selectExpr(
        "id", "concat(CASE WHEN id % 4 < 2 THEN 'trigger ' WHEN id % 4 = 2 THEN 'Trigger ' ELSE 'none ' END, id) AS input", "repeat('x', 100) AS wide")
    got = R.match_exact(texts, rules)
    plan = got._jdf.queryExecution().toString()
    for line in plan.splitlines():
        assert "Exchange hashpartitioning" not in line and "SortMergeJoin" not in line, line
    counts = got.groupBy((F.col("id") % 4).alias("kind")).agg(
        F.count("*").alias("rows"), F.count("exact_ord").alias("hits"), F.bool_and(F.col("exact_ord") == F.col("id")).alias("right"))
    assert {tuple(r) for r in counts.collect()} == {(0, 10_000, 10_000, True), (1, 10_000, 0, None), (2, 10_000, 10_000, True), (3, 10_000, 0, None)}


def test_no_rules(spark):
    got, rejects = R.resolve(
        spark.createDataFrame([(1, "a")], "n int, input string"), spark.createDataFrame([], R.RULE_SCHEMA))
    assert [r["response"] for r in got.collect()] == [None] and rejects.count() == 0


def test_resolving_shuffles_no_input(spark):
    rules = spark.createDataFrame(RULES, R.RULE_SCHEMA)
    got, _ = R.resolve(spark.range(100).selectExpr("cast(id AS string) AS input"), rules)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan


def test_rule_dataset(spark):
    rules = spark.createDataFrame(
        [*RULES, (20, "a", "", ("exact", None, None), "r", T0, T0, True),
         (21, "a", "t", ("exact", None, None), "", T0, T0, True),
         (22, "a", "t", ("exact", None, None), None, T0, T0, True)], R.RULE_SCHEMA)
    got = R.build_rule_dataset(rules).collect()
    assert len(got) == 16 and {r["rule_ord"] for r in got} == {r[0] for r in RULES} - {1}


def test_routes(spark):
    rules = spark.createDataFrame(RULES, R.RULE_SCHEMA)
    chats = spark.createDataFrame(
        [(1, 0, "user", "x"), (1, 1, "user", "hello there"), (2, 0, "user", "hello there"),
         (2, 1, "user", "unknown"), (3, 0, "user", "")],
        "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in R.route_chats(chats, rules, created=7).collect()}
    assert {k: r["route"] for k, r in got.items()} == {1: "rule", 2: "upstream", 3: "rule"}
    envelope = got[1]["envelope"].asDict(recursive=True)
    assert envelope["choices"] == [{"index": 0, "finish_reason": "stop",
                                    "message": {"role": "assistant", "content": "r5"}}]
    assert envelope["object"] == "chat.completion" and envelope["created"] == 7
    assert set(envelope["usage"].values()) == {0} and got[2]["envelope"] is None
    arrays = spark.createDataFrame(
        [(1, [("user", "q"), ("user", "hello there")]), (2, []), (3, None)],
        "conv_id bigint, messages array<struct<role: string, content: string>>")
    routed, rejected = R.route_requests(arrays, rules)
    assert [(r["conv_id"], r["route"]) for r in routed.collect()] == [(1, "rule")]
    assert {(r["conv_id"], r["error_code"]) for r in rejected.collect()} == {
        (2, "INVALID_INPUT"), (3, "INVALID_INPUT")}


def test_passes_store_the_inputs_once(spark, monkeypatch):
    stored = []
    real = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, label, *more: stored.append(label) or real(df, label, *more))
    monkeypatch.setattr(R, "REGEXES_PER_PASS", 2)
    made = [rule(i, f"^{i}$", "regex") for i in range(11)]
    inputs = spark.createDataFrame([(i % 13, str(i % 13)) for i in range(40)], "n int, input string")
    got, _ = R.match_regex(inputs, spark.createDataFrame(made, R.RULE_SCHEMA))
    assert sorted(tuple(r) for r in got.select("n", "regex_ord").collect() if r["n"] < 11) == sorted(
        (i % 13, i % 13) for i in range(40) if i % 13 < 11)
    assert got.filter("regex_ord IS NULL").count() == sum(i % 13 > 10 for i in range(40))
    assert stored.count("regex-inputs") == 1 and stored.count("regex-hits") == 6


def test_patterns_are_checked(spark):
    made = [rule(i, pattern, "regex") for i, pattern in enumerate(["a", "(", "b+", "[z", "c", "(?i", "a{2,1}"])]
    got = R._regexes(spark.createDataFrame(made, R.RULE_SCHEMA)).orderBy("rule_ord").collect()
    assert [r["valid"] for r in got] == [True, False, True, False, True, False, False]


def test_rule_set_document_and_both_flag_spellings(spark, tmp_path):
    document = {"version": "1.0", "pairs": [
        {"id": "b", "trigger": "T", "match": {"type": "exact", "caseInsensitive": True}, "response": "r",
         "createdAt": "2024-01-01T00:00:00.000Z", "updatedAt": "2024-01-02T00:00:00.000Z", "enabled": True},
        {"id": "a", "trigger": "u", "match": {"type": "regex", "normalizeWhitespace": True}, "response": "s"},
    ]}
    (tmp_path / "rules.json").write_text(json.dumps(document, indent=2))
    rules = R.read_rules(spark, str(tmp_path / "rules.json"))
    got = {r["rule_ord"]: r for r in rules.collect()}
    assert tuple(got[0]["match"]) == ("exact", True, None) and got[0]["created_at"] == T0
    assert tuple(got[1]["match"]) == ("regex", None, True) and not got[1]["enabled"]
    log = spark.createDataFrame([
        (5, T0, "PUT", "a", {"match": '{"type": "exact", "caseInsensitive": true}', "enabled": "true"})],
        R.CHANGE_SCHEMA)
    after, _ = R.apply_rule_changes(rules, log)
    assert rule_rows(after) == {
        (0, "b", "T", "r", True, "exact", T0, datetime(2024, 1, 2)), (1, "a", "u", "s", True, "exact", None, T0)}
    found, _ = R.resolve(spark.createDataFrame([("t",), ("U",)], "input string"), after)
    assert {(r["input"], r["matched_ord"]) for r in found.collect()} == {("t", 0), ("U", 1)}


def regex_rules(seed, n):
    """Patterns of words, classes, groups, quantifiers and branches, some of which do not compile."""
    rng = random.Random(seed)
    some = ["hello", "École", "paſsword", "abc", "world", r"\.", r"\d+", "[a-c]x", "[^]]", "(one|two)", "(?:three)?", "x*", "yes+", "no{2}", "z{0,2}",
            "^", "$", ".", r"\bcat", "(?=dog)", "(?i)", "I", "kK", r"\Qa.b\E", "(", "a|b", "long word here|other word", " ", r"\s", "+", "[a&&[^b]]", r"\x41"]
    return [rule(i, "".join(rng.choice(some) for _ in range(rng.randint(1, 4))), "regex", rng.random() < 0.5, rng.random() < 0.3) for i in range(n)]


def test_candidates_by_literals_are_those_that_match(spark, monkeypatch):
    rng = random.Random(3)
    rules = spark.createDataFrame(regex_rules(1, 300), R.RULE_SCHEMA)
    pieces = ["hello", "HELLO", "école", "ÉCOLE", "password", "paſſword", "abc", "ABC", "World", "world", ".", "12", "ax", "one", "two", "three", "x", "yess", "noo",
              "cat", "dog", "i", "ı", "İ", "k", "K", "a.b", "long word here", "long  word\there", "other word", " ", "\n", "A"]
    texts = [None, ""] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    inputs = spark.createDataFrame([(i, t, rng.choice([None, 50, 200])) for i, t in enumerate(texts)], "n int, input string, e bigint")
    for exact in (None, "e"):
        want, rejects = R.match_regex(inputs, rules, exact=exact)
        want = {tuple(r) for r in want.collect()}
        with monkeypatch.context() as patch:
            patch.setattr(R, "REGEXES_PER_PASS", 40)
            got, refused = R.match_regex(inputs, rules, exact=exact)
            assert {tuple(r) for r in got.collect()} == want
            assert sorted(refused.collect()) == sorted(rejects.collect())
    assert sum(r[3] is not None for r in want) > 100 and rejects.count() > 10


def test_a_hundred_thousand_regex_rules(spark, monkeypatch):
    """None of them has to come to the driver: those with a literal are found by it."""
    def no_passes(texts, matched, passes):
        assert next(iter(passes), None) is None
        return matched

    monkeypatch.setattr(R, "_in_passes", no_passes)
    rules = spark.range(100_000).selectExpr(
        "id AS rule_ord", "concat('r', id) AS id",
        "CASE WHEN id % 1000 = 999 THEN concat('code', id, '(') ELSE concat('code', id, '[^0-9]') END AS trigger",
        "named_struct('type', 'regex', 'case_insensitive', id % 2 = 0, 'normalize_ws', id % 3 = 0) AS match",
        "'answer' AS response", "CAST(NULL AS timestamp) AS created_at", "CAST(NULL AS timestamp) AS updated_at", "true AS enabled")
    inputs = spark.range(2000).selectExpr("id AS n", "concat('see CODE', id * 77 % 120000, ' or code', id * 31 % 130000, '.') AS input")
    got, rejects = R.match_regex(inputs, rules)
    one, two = (lambda n: n * 77 % 120000), (lambda n: n * 31 % 130000)
    want = {n: min([c for c in (one(n), two(n)) if c < 100_000 and c % 1000 != 999 and (c == two(n) or c % 2 == 0)], default=None) for n in range(2000)}
    assert {r["n"]: r["regex_ord"] for r in got.collect()} == want
    assert rejects.count() == 100


@pytest.mark.parametrize("pattern, ci, want", [
    ("hello", False, ["hello"]), ("hel+o there", False, ["o there"]), ("hel*o", False, None), ("abcd?e", False, ["abc"]), ("abc|defg", False, ["abc", "defg"]),
    ("abc|de", False, None), (r"a\.b\.c", False, ["a.b.c"]), ("(abc)def", False, ["def"]), ("(?i)abc", False, None), ("x(?i)abc", False, None),
    ("ABCÉDEF", True, ["abc"]), ("ABCÉDEF", False, ["ABCÉDEF"]), (r"\Qabc\E", False, None), ("[abc]defg", False, ["defg"]), ("[]abc]defg", False, None),
    ("ab{2}cde", False, ["cde"]), ("abc|", False, None), (r"abc\d+xyzw", False, ["xyzw"]), ("(a|(b[)])c)dddd", False, ["dddd"]), ("abc)", False, None),
    (r"abc\1", False, None), ("abc++d", False, ["abc"]), ("", False, None), ("ab\\", False, None)])
def test_required_literals(pattern, ci, want):
    assert required_literals(pattern, ci) == want

"""Override rules: the change log that makes them, and matching texts against them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pairworks.functions.patterns import required_literals
from pairworks.functions.text import js_collapse
from pairworks.plans.running import CHUNK, cut, long_keys, running
from pairworks.plans.shared import materialise

MATCH_TYPE = "struct<type: string, case_insensitive: boolean, normalize_ws: boolean>"
RULE_SCHEMA = (
    "rule_ord bigint, id string, trigger string, "
    f"match {MATCH_TYPE}, response string, created_at timestamp, updated_at timestamp, "
    "enabled boolean"
)
CHANGE_SCHEMA = "seq bigint, ts timestamp, op string, id string, body map<string,string>"
_MATCH_JSON = (
    "type string, case_insensitive boolean, normalize_ws boolean, "
    "caseInsensitive boolean, normalizeWhitespace boolean"
)
REGEXES_PER_PASS = 500
SHORT_GRAM, LONG_GRAM = 3, 6
RULES_TO_BROADCAST = 1_000_000
BLOOM_WORDS = 2_000_000
_COMBINATIONS = [(ws, ci) for ws in (False, True) for ci in (False, True)]


def build_rule_dataset(rules: DataFrame) -> DataFrame:
    """Training pairs from the enabled rules that have a trigger and a response."""
    usable = F.col("enabled") & (F.col("trigger") != "") & (F.col("response") != "")
    return rules.filter(usable).select(
        "rule_ord", F.col("trigger").alias("input"), F.col("response").alias("target"))


def match_struct(match: Column) -> Column:
    """The match settings from JSON with the flags in either spelling."""
    return F.when(match.isNotNull(), F.struct(
        match["type"].alias("type"),
        F.coalesce(match["case_insensitive"], match["caseInsensitive"]).alias("case_insensitive"),
        F.coalesce(match["normalize_ws"], match["normalizeWhitespace"]).alias("normalize_ws")))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a rule-set document {version, pairs: [...]}; their order is that of the list."""
    pair = (
        f"struct<id: string, trigger: string, match: struct<{_MATCH_JSON}>, response: string, "
        "createdAt: string, updatedAt: string, enabled: boolean>"
    )
    listed = spark.read.schema(f"version string, pairs array<{pair}>").json(path, multiLine=True)
    return listed.select(F.posexplode("pairs").alias("rule_ord", "_pair")).select(
        F.col("rule_ord").cast("bigint").alias("rule_ord"), "_pair.id", "_pair.trigger",
        match_struct(F.col("_pair.match")).alias("match"), "_pair.response",
        F.col("_pair.createdAt").try_cast("timestamp").alias("created_at"),
        F.col("_pair.updatedAt").try_cast("timestamp").alias("updated_at"),
        F.coalesce("_pair.enabled", F.lit(False)).alias("enabled"))


# --- change log -------------------------------------------------------------------------------


def apply_rule_changes(
    rules: DataFrame, changes: DataFrame, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """(rules, rejects) after a change log.

    POST appends a rule, also under an id that is taken. PUT merges its body into the first live
    rule of the id and DELETE removes that rule; without one, either is rejected as NOT_FOUND.
    The place of a POST in the log is the rule's order, so `rule_ord` of `rules` must lie below
    the new `seq`s.

    Per id this is a queue, and its state follows from running totals: with S = POSTs - DELETEs,
    the lowest S so far tells how many DELETEs found the queue empty, hence how many rules are
    gone and which rule (slot) each change falls on. Changes are then merged per slot.
    """
    earlier = rules.select(
        F.col("rule_ord").alias("seq"), F.col("updated_at").alias("ts"), F.lit("POST").alias("op"),
        "id", _as_body().alias("body"), F.col("created_at").alias("_created"),
        F.lit(True).alias("_earlier"))
    later = changes.select(
        "seq", "ts", "op", _change_id().alias("id"),
        F.coalesce("body", F.create_map().cast("map<string,string>")).alias("body"),
        F.col("ts").alias("_created"), F.lit(False).alias("_earlier"))
    log = earlier.unionByName(later).withColumn("_problem", _problem())

    is_post, is_delete = F.col("op") == "POST", F.col("op") == "DELETE"
    usable = log.filter(F.col("_problem").isNull()).withColumns({
        "_step": F.when(is_post, 1).when(is_delete, -1).otherwise(0).cast("bigint"),
        "_post": is_post.cast("bigint"),
        "_delete": is_delete.cast("bigint"),
    })
    long = long_keys(usable, ["id"], "seq", chunk)
    counted = running(cut(usable, ["id"], "seq", long), "seq", {
        "_s": ("sum", "_step"), "_posts": ("sum", "_post"), "_deletes": ("sum", "_delete"),
    }, long=long)
    lowest = running(counted, "seq", {"_low": ("min", "_s")}, inclusive=False, long=long)
    low_before = F.least(F.lit(0), F.coalesce("_low", F.lit(0)))
    live_before = F.col("_s") - F.col("_step") - low_before
    gone = F.col("_deletes") + F.least(low_before, F.col("_s"))
    slotted = materialise(lowest.select(
        "seq", "ts", "op", "id", "body", "_created",
        (is_post | (live_before > 0)).alias("_found"),
        F.when(is_post, F.col("_posts")).when(is_delete, gone).otherwise(gone + 1).alias("_slot"),
    ), "slotted-changes")

    missing = slotted.filter(~F.col("_found")).select(
        "seq", "op", "id", F.lit("NOT_FOUND").alias("error_code"),
        F.lit("Not found").alias("error_message"))
    invalid = log.filter(F.col("_problem").isNotNull()).select(
        "seq", "op", "id", F.lit("INVALID_INPUT").alias("error_code"),
        F.col("_problem").alias("error_message"))
    return _merge(slotted.filter("_found")), invalid.unionByName(missing)


def changed_ids(changes: DataFrame) -> DataFrame:
    """The ids of the rules that a change log may touch."""
    return changes.select(_change_id().alias("id")).filter("id IS NOT NULL").distinct()


def _change_id() -> Column:
    """The id a change names; a POST may name it in its body or leave it to be made."""
    made = F.coalesce(F.col("body")["id"], F.sha2(F.col("seq").cast("string"), 256))
    return F.coalesce("id", F.when(F.col("op") == "POST", made))


def _problem() -> Column:
    op = F.col("op")
    return (
        F.when(~F.coalesce(op.isin("POST", "PUT", "DELETE"), F.lit(False)), "Unknown operation")
        .when(F.col("id").isNull(), "Missing id")
        .when((op == "PUT") & (F.coalesce(F.col("body")["id"], F.col("id")) != F.col("id")),
              "The id of a rule cannot change")
    )


def _as_body() -> Column:
    return F.create_map(
        F.lit("trigger"), F.col("trigger"), F.lit("response"), F.col("response"),
        F.lit("enabled"), F.col("enabled").cast("string"), F.lit("match"), F.to_json("match"))


def _merge(changes: DataFrame) -> DataFrame:
    """One rule per (id, slot): of every field the value of the last change that names it."""
    edits = F.col("op") != "DELETE"
    post = F.col("op") == "POST"

    def latest(field: str, also: Column = edits) -> Column:
        named = also & F.map_contains_key("body", field)
        return F.max_by(F.col("body")[field], F.when(named, F.col("seq"))).alias(f"_{field}")

    made = F.max(F.when(post, F.col("_created")))
    merged = changes.groupBy("id", "_slot").agg(
        F.min(F.when(post, F.col("seq"))).alias("rule_ord"),
        latest("trigger"), latest("response"), latest("enabled"), latest("match"),
        latest("createdAt", F.col("op") == "PUT"), made.alias("_made"),
        F.max_by("ts", F.when(edits, F.col("seq"))).alias("updated_at"),
        F.bool_or(F.col("op") == "DELETE").alias("_deleted"),
    )
    match = F.from_json("_match", _MATCH_JSON)
    created = F.coalesce(F.col("_createdAt").try_cast("timestamp"), F.col("_made"))
    return merged.filter(~F.col("_deleted")).select(
        "rule_ord", "id", F.col("_trigger").alias("trigger"),
        match_struct(match).alias("match"), F.col("_response").alias("response"),
        created.alias("created_at"), "updated_at",
        F.coalesce(F.col("_enabled").try_cast("boolean"), F.lit(False)).alias("enabled"))


# --- matching ---------------------------------------------------------------------------------


def normalised(text: Column, normalize_ws: bool, case_insensitive: bool) -> Column:
    if normalize_ws:
        text = js_collapse(text)
    return F.lower(text) if case_insensitive else text


def _digest(text: Column, normalize_ws: bool, case_insensitive: bool) -> Column:
    return F.unhex(F.sha2(normalised(text, normalize_ws, case_insensitive), 256))


def _flags(rules: DataFrame, kind: str) -> DataFrame:
    """The enabled rules of a kind with their two flags; absent flags are off."""
    return rules.filter(F.col("enabled") & (F.col("match.type") == kind)).select(
        "rule_ord", "id", "trigger", "response",
        F.coalesce("match.normalize_ws", F.lit(False)).alias("_ws"),
        F.coalesce("match.case_insensitive", F.lit(False)).alias("_ci"))


def match_exact(inputs: DataFrame, rules: DataFrame, column: str = "input") -> DataFrame:
    """Adds `exact_ord`: the first exact rule that equals the text under the rule's flags.

    Of the rules with one key only the first can win, and keys are digests, so a rule is a few
    dozen bytes whatever its text. Up to a counted million rules each of the up to four flag
    combinations in use is a broadcast join that finds at most one rule per row. Beyond that
    `_match_many` goes over digests alone and joins the rows it found something for once.
    """
    exact = _flags(rules, "exact")
    key = F.coalesce(*[
        F.when((F.col("_ws") == ws) & (F.col("_ci") == ci), _digest(F.col("trigger"), ws, ci))
        for ws, ci in _COMBINATIONS])
    wins = materialise(
        exact.withColumn("_key", key).filter(F.col("_key").isNotNull())
        .groupBy("_ws", "_ci", "_key").agg(F.min("rule_ord").alias("_ord")),
        "exact-rules",
    )
    used = {(r["_ws"], r["_ci"]) for r in wins.select("_ws", "_ci").distinct().collect()}
    combinations = [c for c in _COMBINATIONS if c in used]
    if wins.limit(RULES_TO_BROADCAST + 1).count() > RULES_TO_BROADCAST:
        return _match_many(inputs, wins, combinations, column)
    found = inputs
    ords = []
    for i, (ws, ci) in enumerate(combinations):
        side = F.broadcast(wins.filter((F.col("_ws") == ws) & (F.col("_ci") == ci)).select(
            F.col("_key").alias(f"_key{i}"), F.col("_ord").alias(f"_ord{i}")))
        found = found.join(
            side, _digest(F.col(column), ws, ci) == F.col(f"_key{i}"), "left").drop(f"_key{i}")
        ords.append(F.col(f"_ord{i}"))
    first = F.least(*ords) if len(ords) > 1 else ords[0] if ords else F.lit(None).cast("bigint")
    return found.select(*inputs.columns, first.alias("exact_ord"))


def _match_many(inputs: DataFrame, wins: DataFrame, combinations: list[tuple[bool, bool]], column: str) -> DataFrame:
    """`match_exact` with more rules than are broadcast, of which `wins` are the first per key.

    A text becomes a row per flag combination with two digests, its own and the one to look up.
    A Bloom filter of the rules drops nearly all that no rule has before anything is shuffled, and
    equal texts become one on the way. The texts found are few dozen bytes each; a filter made
    of them leaves only rows that will most likely match to be joined, the others pass by.
    """
    text = F.col(column)
    looked_up = F.array(*[
        F.struct(F.lit(ws).alias("_ws"), F.lit(ci).alias("_ci"), _digest(text, ws, ci).alias("_key"))
        for ws, ci in combinations])
    own = F.unhex(F.sha2(text, 256))
    asked = inputs.filter(text.isNotNull()).select(own.alias("_whole"), F.explode(looked_up).alias("_asked")).select(
        "_whole", "_asked.*")
    # The joins on keys see one row per distinct text: a text that a third of the rows have is no hot key.
    asked = _likely(asked, "_key", wins, "_key").distinct()
    found = materialise(asked.join(wins, ["_ws", "_ci", "_key"]).groupBy("_whole").agg(F.min("_ord").alias("exact_ord")), "exact-found")
    # One filter in two branches: rows it lets through are joined, and a null passes neither.
    tagged, passed = _with_likely(inputs.withColumn("_whole", own), "_whole", found, "_whole")
    matched = tagged.filter(passed).join(found, "_whole", "left").select(*inputs.columns, "exact_ord")
    return matched.unionByName(tagged.filter(~passed).select(*inputs.columns, F.lit(None).cast("bigint").alias("exact_ord")))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(words))


def _mask(key: Column) -> Column:
    """Three of the 64 bits of a word."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)).cast("int"))
            for i in (2, 3, 4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _with_likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, Column]:
    """`rows` with the word of a blocked Bloom filter of `wanted` that `key` falls on, and whether it holds the key.

    The filter is a table of at most BLOOM_WORDS words of 64 bits, eight keys to a word, broadcast by that
    bound. With far more keys than that it lets most through, which costs time and changes no result.
    """
    words = max(1, min(BLOOM_WORDS, wanted.count() // 8))
    wanted_col = F.col(wanted_key)
    bloom = materialise(
        wanted.select(_word(wanted_col, words).alias("_word"), _mask(wanted_col).alias("_bits"))
        .groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "bloom")
    tagged = rows.withColumn("_word", _word(F.col(key), words)).join(F.broadcast(bloom), "_word", "left").drop("_word")
    mask = _mask(F.col(key))
    passed = F.col(key).isNotNull() & F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return tagged, passed


def _likely(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    tagged, passed = _with_likely(rows, key, wanted, wanted_key)
    return tagged.filter(passed).drop("_bits")


def _pattern(rule: Row) -> str:
    return ("(?iu)" if rule["_ci"] else "") + rule["trigger"]


@F.pandas_udf(ArrayType(StringType()))
def _literals(patterns: pd.Series, case_insensitive: pd.Series) -> pd.Series:
    return pd.Series([required_literals(p, bool(ci)) for p, ci in zip(patterns, case_insensitive)])


def _regexes(rules: DataFrame) -> DataFrame:
    """The regex rules with `pattern`, `valid` (it compiles, asked of Java in the tasks) and `literals`, null where
    every text must be tried."""
    pattern = F.concat(F.when(F.col("_ci"), "(?iu)").otherwise(""), F.col("trigger"))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern"))
    made = _flags(rules, "regex").filter(F.col("trigger").isNotNull()).select(
        "rule_ord", "id", "trigger", "_ws", "_ci", pattern.alias("pattern"))
    made = made.withColumn("valid", compiled.isNotNull())
    return materialise(made.withColumn("literals", F.when(F.col("valid"), _literals("trigger", "_ci"))), "regex-rules")


def _passes(regexes: DataFrame) -> Iterator[list[Row]]:
    """Rules in order, a bounded number at a time."""
    listed = regexes.select("rule_ord", "trigger", "_ws", "_ci").orderBy("rule_ord").toLocalIterator()
    while some := list(islice(listed, REGEXES_PER_PASS)):
        yield some


def match_regex(
    inputs: DataFrame, rules: DataFrame, column: str = "input", exact: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(inputs with `regex_ord`, rejected rules): the first regex rule found in the text.

    Up to REGEXES_PER_PASS rules become one COALESCE, so a row stops at its first match, nothing is
    joined and every pattern is compiled once per task. With more, a pattern is tried only on texts
    that hold a gram of the literals it needs, found by an equi-join; rules without such a literal
    are tried on all texts that have no earlier match yet, REGEXES_PER_PASS at a time. Beyond these
    passes no rule comes to the driver. `exact` names a column with the exact match, past which no
    regex needs to be tried. A pattern that does not compile is rejected and skipped.
    """
    regexes = _regexes(rules)
    usable = regexes.filter("valid")
    rejects = regexes.filter(~F.col("valid")).select("rule_ord", "id", "trigger").withColumns({
        "error_code": F.lit("INVALID_INPUT"), "error_message": F.lit("Invalid regex pattern")})
    first = usable.select("rule_ord", "trigger", "_ws", "_ci").orderBy("rule_ord").limit(REGEXES_PER_PASS + 1).collect()
    if len(first) <= REGEXES_PER_PASS:
        found = inputs.withColumn(
            "regex_ord", _first_regex(first, column, exact) if first else F.lit(None).cast("bigint"))
        return found, rejects

    stored = materialise(inputs.withColumn("_regex_row", F.monotonically_increasing_id()), "regex-inputs")
    texts = stored.select(
        "_regex_row", F.col(column).alias("_text"), (F.col(exact) if exact else F.lit(None)).cast("bigint").alias("_exact"))
    matched = _by_literals(texts.filter("_text IS NOT NULL"), usable.filter("literals IS NOT NULL"))
    matched = _in_passes(texts, matched, _passes(usable.filter("literals IS NULL")))
    return stored.join(matched, "_regex_row", "left").drop("_regex_row"), rejects


def _folded(text: Column, normalize_ws: bool, case_insensitive: bool) -> Column:
    """The text in which literals are looked for; Java takes a long s and a dotless i for the plain ones."""
    text = normalised(text, normalize_ws, case_insensitive)
    return F.translate(text, "\u017f\u0131", "si") if case_insensitive else text


def _by_literals(texts: DataFrame, regexes: DataFrame) -> DataFrame:
    """(_regex_row, regex_ord): the first of the rules with literals that is found in each text.

    Of each literal the gram counts that the fewest other literals share. Only grams, rows' numbers
    and rules' orders are joined to find candidates; a text is shuffled once if it has any.
    """
    literals = regexes.select("rule_ord", "_ws", "_ci", F.explode("literals").alias("literal"))
    size = F.when(F.length("literal") >= LONG_GRAM, LONG_GRAM).otherwise(SHORT_GRAM)
    grams = literals.withColumn("gram", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("literal") - size + 1), lambda i: F.substr(F.col("literal"), i, size))))
    shared = grams.groupBy("_ws", "_ci", "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(shared, ["_ws", "_ci", "gram"]).groupBy("rule_ord", "_ws", "_ci", "literal").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    rarest = materialise(rarest.select("_ws", "_ci", "gram", "rule_ord").distinct(), "regex-grams", RULES_TO_BROADCAST)
    used = [tuple(r) for r in rarest.select("_ws", "_ci", F.length("gram").alias("n")).distinct().collect()]
    if not used:
        return texts.sparkSession.createDataFrame([], "_regex_row bigint, regex_ord bigint")

    def held(ws: bool, ci: bool, n: int) -> Column:
        # A lookahead finds a gram at every character, in one pass over the text.
        found = F.array_distinct(F.regexp_extract_all(_folded(F.col("_text"), ws, ci), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        return F.transform(found, lambda gram: F.struct(F.lit(ws).alias("_ws"), F.lit(ci).alias("_ci"), gram.alias("gram")))

    there = texts.select("_regex_row", "_exact", F.explode(F.concat(*[held(*combination) for combination in used])).alias("held"))
    candidates = there.select("_regex_row", "_exact", "held.*").join(rarest, ["_ws", "_ci", "gram"]).filter(
        F.coalesce(F.col("rule_ord") < F.col("_exact"), F.lit(True))).select("_regex_row", "rule_ord").distinct()
    text = F.coalesce(*[
        F.when((F.col("_ws") == ws) & (F.col("_ci") == ci), normalised(F.col("_text"), ws, ci)) for ws, ci in _COMBINATIONS])
    pairs = candidates.join(regexes.select("rule_ord", "_ws", "_ci", "pattern"), "rule_ord").join(texts.select("_regex_row", "_text"), "_regex_row")
    return materialise(pairs.filter(F.rlike(text, F.col("pattern"))).groupBy("_regex_row").agg(
        F.min("rule_ord").alias("regex_ord")), "regex-hits")


def _in_passes(texts: DataFrame, matched: DataFrame, passes: Iterable[list[Row]]) -> DataFrame:
    """`matched` with the rules of the passes as well. A pass stores the rows it matches, and reads each text
    up to its first match so far."""
    for some in passes:
        left = texts.join(matched, "_regex_row", "left").withColumn("_past", F.least("_exact", "regex_ord"))
        hits = materialise(
            left.select("_regex_row", _first_regex(some, "_text", "_past").alias("regex_ord")).filter("regex_ord IS NOT NULL"), "regex-hits")
        matched = materialise(matched.unionByName(hits).groupBy("_regex_row").agg(F.min("regex_ord").alias("regex_ord")), "regex-matched")
    return matched


def _first_regex(some: list[Row], column: str, exact: str | None) -> Column:
    """The first of some regex rules that is found.

    Inside a lambda the texts of the up to four flag combinations are made once per row, and an
    expression of any length needs no generated code.
    """
    used = sorted({(r["_ws"], r["_ci"]) for r in some})
    past = F.coalesce(F.col(exact), F.lit(2**63 - 1)) if exact else F.lit(2**63 - 1)
    seen = F.struct(
        past.alias("past"),
        *[normalised(F.col(column), ws, ci).alias(f"text{i}") for i, (ws, ci) in enumerate(used)])

    def search(row: Column) -> Column:
        texts = {flags: row[f"text{i}"] for i, flags in enumerate(used)}
        past = row["past"]
        return F.coalesce(*[
            F.when((past > rule["rule_ord"]) & texts[rule["_ws"], rule["_ci"]].rlike(_pattern(rule)),
                   F.lit(rule["rule_ord"]).cast("bigint"))
            for rule in some])

    return F.transform(F.array(seen), search)[0]


def resolve(
    inputs: DataFrame, rules: DataFrame, column: str = "input", match_empty: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(inputs with matched_id and response, rejected rules): the first rule that matches.

    Exact and regex rules compete by `rule_ord`. Rules of any other type never match, and an
    empty text matches nothing unless `match_empty`.
    """
    text = F.col(column) if match_empty else F.nullif(F.col(column), F.lit(""))
    live = materialise(rules.filter("enabled"), "rules")
    tried = match_exact(inputs.withColumn("_text", text), live, "_text")
    tried, rejects = match_regex(tried, live, "_text", "exact_ord")
    answers = live.select(
        F.col("rule_ord").alias("_ord"), F.col("id").alias("matched_id"), "response")
    first = F.least("exact_ord", "regex_ord")
    resolved = tried.withColumn("matched_ord", first).join(
        answers, F.col("matched_ord") == F.col("_ord"), "left")
    return resolved.select(*inputs.columns, "matched_ord", "matched_id", "response"), rejects


# --- chats ------------------------------------------------------------------------------------


def route_chats(
    messages: DataFrame,
    rules: DataFrame,
    model: str = "override-rules",
    id_prefix: str = "chatcmpl-",
    created: int = 0,
) -> DataFrame:
    """(conv_id, route, matched_id, input, envelope) for chats as (conv_id, turn, role, text).

    The last message is matched; a turn must not repeat within a chat. Texts are not sorted to find
    it: turns are compared first, and whole messages meet the last turns. A match is answered with a completion envelope; other chats
    have the route 'upstream'; see `answer_chats`.
    """
    ends = messages.groupBy(F.col("conv_id").alias("_conv")).agg(F.max("turn").alias("_end"))
    last = messages.join(
        ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_end")), "left_semi")
    return _routed(last.select("conv_id", F.col("text").alias("input")), rules, model, id_prefix, created)


def route_requests(
    requests: DataFrame,
    rules: DataFrame,
    model: str = "override-rules",
    id_prefix: str = "chatcmpl-",
    created: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(routed, rejected) for chats as (conv_id, messages array<struct<role, content>>)."""
    empty = F.coalesce(F.size("messages") <= 0, F.lit(True))
    rejected = requests.filter(empty).select(
        "conv_id", F.lit("INVALID_INPUT").alias("error_code"),
        F.lit("Invalid messages").alias("error_message"))
    last = requests.filter(~empty).select(
        "conv_id", F.element_at("messages", -1)["content"].alias("input"))
    return _routed(last, rules, model, id_prefix, created), rejected


def envelope(conv_id: Column, content: Column, model: Column, id_prefix: str, created: int) -> Column:
    """A reply in the form of a chat completion."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    choice = F.struct(
        F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    return F.struct(
        F.concat(F.lit(id_prefix), conv_id.cast("string")).alias("id"),
        F.lit("chat.completion").alias("object"),
        F.lit(created).cast("bigint").alias("created"),
        model.alias("model"),
        F.array(choice).alias("choices"),
        F.struct(F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"),
                 F.lit(0).alias("total_tokens")).alias("usage"))


def _routed(
    last: DataFrame, rules: DataFrame, model: str, id_prefix: str, created: int
) -> DataFrame:
    resolved, _ = resolve(last, rules, match_empty=True)
    matched = F.col("matched_ord").isNotNull()
    reply = envelope(F.col("conv_id"), F.col("response"), F.lit(model), id_prefix, created)
    return resolved.select(
        "conv_id", F.when(matched, "rule").otherwise("upstream").alias("route"), "matched_id",
        "input", F.when(matched, reply).alias("envelope"))

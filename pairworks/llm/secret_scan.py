"""Secrets in texts: three base kinds, and weak parts of a credential that count only together.

The base kinds (assignments, access identifiers, long hexadecimal numbers) are reported wherever
they are. The weak kinds (user names, long runs of key characters, endpoints) are reported only
where a complementary part lies within reach: the parts of a text are interval-joined, each
widened by the reach, and a weak part without a partner is left out. Parts that overlap are one
thing and no partners: an address, a path or a number is never its own credential. A scope never
leaves its document, so that the join runs over the arrays of one row, and no row or part is
shuffled. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.llm.common import fresh_name

# Kinds in the order in which they are listed, with pattern, group and least length.
# `+` stands where a match that is too short still uses up its characters; maximal runs of one
# class may be searched by their least length at once.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "user": (r"""(?i)(user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]+)""", 2, 3),
    "blob": (r"[A-Za-z0-9+/]{40,}", 0, 40),
    "endpoint": (r"""(https?|ftp|jdbc:[a-z]+|postgres(ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", 0, 1),
    # An endpoint with a user's password in it, which needs no partner.
    "userinfo": (r"""(https?|ftp|jdbc:[a-z]+|postgres(ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>/@:]*:[^\x00-\x20"'<>/@]+@[^\x00-\x20"'<>]+""", 0, 1),
}
KINDS = [*BASE, *WEAK]
# What a part must hold besides: a digit, and letters of both cases in a stretch without a slash. Else it
# is a word, a path or a number.
HOLDS = {"blob": ("[0-9]", ["[a-z]", "[A-Z]"])}
STRETCH_CHARS = 12
# What a weak part needs within reach. A hexadecimal number by an address is as often a digest as a key.
COMPLEMENTS = {
    "user": ["assign", "hex", "blob"],
    "blob": ["access", "user", "endpoint"],
    "endpoint": ["assign", "blob"],
    "userinfo": [],
}
# Parts that count only if they overlap none of these; an assignment within an address is no partner of addresses.
APART = {"blob": ["endpoint"], "user": [*BASE, "blob"], "assign": ["endpoint"]}
_SPAN = "array<struct<start:int,ord:int,end:int>>"
_CHUNK = 256
_NOWHERE = -(1 << 30)
_BLOCK = 1024  # code points of a text that are cut at a time
_STRETCH = 64  # blocks for which spans are looked up together


def _no_spans() -> Column:
    return F.array().cast(_SPAN)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _scan(rows: Column, zero: int, merge: Callable[[Column, Column], Column], value: Callable[[Column], Column],
          emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """`emit` of each row and of the sum of the values before it, `merge` being the addition.

    Chunks are summed first, then each chunk is gone through from the sum before it, so that
    growing arrays are copied within chunks only.
    """
    none = F.array().cast(f"array<{kind}>")

    def through(chunk: Column, before: Column) -> Column:
        state = F.struct(before.alias("sum"), none.alias("out"))
        return F.aggregate(chunk, state, lambda s, r: F.struct(
            merge(s["sum"], value(r)).alias("sum"), F.concat(s["out"], F.array(emit(s["sum"], r))).alias("out")),
            lambda s: s["out"])

    def chunked(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), lambda s, r: merge(s, value(r))))
        state = F.struct(F.lit(zero).alias("sum"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(sums, state, lambda s, n: F.struct(
            merge(s["sum"], n).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(chunks, before, through))

    def cut(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / _CHUNK).cast("int"))
        return _with(F.transform(numbers, lambda i: F.slice(whole, i * _CHUNK + 1, _CHUNK)), chunked)

    return _with(rows, lambda whole: F.when(F.size(whole) > 0, cut(whole)).otherwise(none))


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind. The texts between and the texts of the matches give the places: a match
    starts where the lengths of all before it add up to."""
    pattern, group, least = (BASE | WEAK)[kind]
    order = KINDS.index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = _with(matches, lambda found: F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("n"))))

    def counts(value: Column) -> Column:
        enough = F.length(value) >= least
        if kind not in HOLDS:
            return enough
        whole, within = HOLDS[kind]
        holds = lambda stretch: reduce(Column.__and__, [stretch.rlike(what) for what in within], F.length(stretch) >= STRETCH_CHARS)
        return enough & value.rlike(whole) & F.exists(F.split(value, "/"), holds)

    rows = F.zip_with(lengths, values, lambda row, value: F.struct(
        row["gap"].alias("gap"), row["n"].alias("n"), counts(value).alias("counts")))

    def emit(at: Column, row: Column) -> Column:
        begin = at + row["gap"]
        return F.struct(F.struct(begin.alias("start"), F.lit(order).alias("ord"), (begin + row["n"]).alias("end")).alias("span"),
                        row["counts"].alias("counts"))

    placed = _scan(rows, 0, lambda a, b: a + b, lambda row: row["gap"] + row["n"], emit,
                   "struct<span:struct<start:int,ord:int,end:int>,counts:boolean>")
    spans = F.transform(F.filter(placed, lambda p: p["counts"]), lambda p: p["span"])
    return F.when(text.rlike(pattern), spans).otherwise(_no_spans())


def _near(spans: Column, others: Column, reach: int, wanted: bool = True) -> Column:
    """The spans that have one of the others within reach, or those that have none.

    An interval join by a sweep: the others come in the order of their starts, a span where all
    that start before its end and the reach have come; the largest end until then decides.
    """
    event = lambda s, key, is_span: F.struct(
        key.alias("key"), F.lit(0 if is_span else 1).alias("other"), s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"))
    events = F.sort_array(F.concat(F.transform(spans, lambda s: event(s, s["end"] + reach, True)),
                                   F.transform(others, lambda s: event(s, s["start"], False))))
    seen = _scan(events, _NOWHERE, F.greatest, lambda e: F.when(e["other"] == 1, e["end"]).otherwise(F.lit(_NOWHERE)),
                 lambda end, e: F.struct(F.struct(e["start"].alias("start"), e["ord"].alias("ord"), e["end"].alias("end")).alias("span"),
                                         ((e["other"] == 0) & ((end + reach > e["start"]) == wanted)).alias("keep")),
                 "struct<span:struct<start:int,ord:int,end:int>,keep:boolean>")
    kept = F.transform(F.filter(seen, lambda e: e["keep"]), lambda e: e["span"])
    return F.when(F.size(spans) > 0, kept).otherwise(_no_spans())


def _not_within(spans: Column, others: Column) -> Column:
    """The spans that lie within none of the others, by a sweep as in _near: where a span starts, the
    largest end of the others that have started until then decides."""
    event = lambda s, key, other: F.struct(
        key.alias("key"), F.lit(other).alias("other"), s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"))
    events = F.sort_array(F.concat(F.transform(spans, lambda s: event(s, s["start"] + 1, 0)),
                                   F.transform(others, lambda s: event(s, s["start"], 1))))
    seen = _scan(events, _NOWHERE, F.greatest, lambda e: F.when(e["other"] == 1, e["end"]).otherwise(F.lit(_NOWHERE)),
                 lambda end, e: F.struct(F.struct(e["start"].alias("start"), e["ord"].alias("ord"), e["end"].alias("end")).alias("span"),
                                         ((e["other"] == 0) & (end < e["end"])).alias("keep")),
                 "struct<span:struct<start:int,ord:int,end:int>,keep:boolean>")
    kept = F.transform(F.filter(seen, lambda e: e["keep"]), lambda e: e["span"])
    return F.when(F.size(spans) > 0, kept).otherwise(_no_spans())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["ord"] + 1), s["start"], s["end"])), ",")


def with_spans(df: DataFrame, text_col: str = "text", reach: int = 200, base_col: str = "base_spans",
               all_col: str = "all_spans", overhang: bool = False) -> DataFrame:
    """`df` with two arrays of (start, ord, end), sorted: the base spans, and all that are reported.

    Places are code points, the end exclusive; `ord` counts KINDS. A null or empty text has none.
    `reach` is the most code points between two parts that go together. Only the base kinds and addresses
    with a password in them are reported alone. A blob that overlaps a
    base span is that span and not reported again; with `overhang` that holds only for a blob within
    a base span, and one that sticks out is a blob whose partner is the base span. Rows, repeated or not, and all other columns
    stay as they are; two columns are added and must not be there yet.
    """
    for name in (base_col, all_col):
        if name.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"the table has a column {name}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = fresh_name(df, "parts")
    found = df.withColumn(parts, F.struct(*[_spans(text, kind).alias(kind) for kind in KINDS]))
    # Worked out once per row: an explode of one element keeps Spark from copying it into each use.
    found = found.withColumn(parts, F.explode(F.array(parts)))
    part = {kind: F.col(parts)[kind] for kind in KINDS}
    base = F.sort_array(F.concat(*[part[kind] for kind in BASE]))
    apart = {kind: _near(part[kind], F.concat(*[part[other] for other in others]), 0, wanted=False) for kind, others in APART.items()}
    blobs = _not_within(apart["blob"], base) if overhang else _near(apart["blob"], base, 0, wanted=False)
    found = found.withColumn(parts, F.explode(F.array(F.struct(
        base.alias("base"), *[part[kind].alias(kind) for kind in KINDS if kind not in ("user", "blob")], apart["user"].alias("user"),
        blobs.alias("blob"), apart["assign"].alias("free")))))
    part = {kind: F.col(parts)[kind] for kind in [*KINDS, "free"]}
    base = F.col(parts)["base"]
    free = lambda kind, other: "free" if (kind, other) == ("endpoint", "assign") else other
    weak = [_near(part[kind], F.concat(*[part[free(kind, other)] for other in others]), reach) if others else part[kind]
            for kind, others in COMPLEMENTS.items()]
    if overhang:
        weak = [F.array_distinct(F.concat(*weak, _near(part["blob"], base, 0)))]
    some_weak = F.lit(False)
    for kind in WEAK:
        some_weak = some_weak | (F.size(part[kind]) > 0)
    return found.withColumns({
        base_col: base,
        all_col: F.when(some_weak, F.sort_array(F.concat(base, *weak))).otherwise(base)}).drop(parts)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Per row: the id, counts of the base kinds, base_sha256 and spans; rows without a secret too."""
    base = F.col("base_spans")
    count = lambda kind: F.size(F.filter(base, lambda s: s["ord"] == KINDS.index(kind))).cast("long")
    return with_spans(df.select(F.col(id_col), F.col(text_col)), text_col, reach).select(
        id_col, *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", reach: int = 200, mark: str = "[secret]", overhang: bool = False) -> DataFrame:
    """`df` with every reported span in its texts replaced by `mark`; overlapping spans become one.

    `overhang` is that of with_spans. Texts without a span, and null texts, stay as they are; columns of any
    name come through.
    """
    base_col, all_col = fresh_name(df, "base_spans"), fresh_name(df, "all_spans")
    text, spans = F.col(text_col), F.col(all_col)
    # Spans that begin within an earlier one add no mark of their own.
    led = _scan(spans, 0, F.greatest, lambda s: s["end"], lambda end, s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), (s["start"] >= end).alias("lead")), "struct<start:int,end:int,lead:boolean>")

    def within(some: Column, begin: Column, length: int) -> Column:
        return F.filter(some, lambda s: (s["end"] > begin) & (s["start"] < begin + length))

    def cut(block: Column, some: Column, begin: Column) -> Column:
        def add(state: Column, span: Column) -> Column:
            here = span["start"] - begin
            gap = F.substr(block, state["at"] + 1, F.greatest(here - state["at"], F.lit(0)))
            return F.struct(F.greatest(state["at"], span["end"] - begin).alias("at"),
                            F.when(span["lead"] & (here >= 0), F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

        state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(some, state, add, lambda s: F.concat(s["out"], F.substr(block, s["at"] + 1, F.lit(_BLOCK))))

    def stretch(blocks: Column, i: Column, led: Column) -> Column:
        begin = i * (_BLOCK * _STRETCH)
        return _with(within(led, begin, _BLOCK * _STRETCH), lambda some: F.array_join(F.transform(
            F.slice(blocks, i * _STRETCH + 1, _STRETCH),
            lambda block, j: cut(block, within(some, begin + j * _BLOCK, _BLOCK), begin + j * _BLOCK)), ""))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    whole = _with(F.struct(blocks.alias("blocks"), led.alias("led")), lambda row: F.array_join(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(row["blocks"]) - 1) / _STRETCH).cast("int")),
        lambda i: stretch(row["blocks"], i, row["led"])), ""))
    return with_spans(df, text_col, reach, base_col, all_col, overhang).withColumn(
        text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).drop(base_col, all_col)

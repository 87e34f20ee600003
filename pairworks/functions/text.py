"""Text expressions; every function takes and returns a Column."""

from __future__ import annotations

import re
import uuid
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.functions import fixed_values as fixed


def _class(chars: str) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in chars) + "]"


def py_strip(col: Column) -> Column:
    return F.btrim(col, F.lit(fixed.PYTHON_WHITESPACE))


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(fixed.JS_WHITESPACE))


def js_collapse(col: Column) -> Column:
    """Trimmed, with every whitespace run turned into one space."""
    return F.regexp_replace(js_trim(col), _class(fixed.JS_WHITESPACE) + "+", " ")


def strip_fences(col: Column) -> Column:
    """Markdown fences removed wherever they occur, then trimmed."""
    for fence in fixed.FENCES:
        col = F.replace(col, F.lit(fence), F.lit(""))
    return js_trim(col)


def sanitize_for_log(col: Column, length: int | None = None) -> Column:
    """A text on one line, cut to `length` characters if that is given."""
    line = F.regexp_replace(col, "[\n\r]", " ")
    return line if length is None else F.substring(line, 1, length)


def safe_file_name(col: Column) -> Column:
    return F.regexp_replace(col, fixed.UNSAFE_NAME_CHARS, "_")


def base_name(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def unescape(col: Column) -> Column:
    """Percent-escapes resolved once; a plus sign is a plus sign."""
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def fill(template: str, **values: Column) -> Column:
    """A str.format-style template with columns as its fields."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts)


def digest(*cols: Column) -> Column:
    """SHA-256 over several texts; null differs from the empty text, and lengths keep
    ("ab", "c") apart from ("a", "bc")."""
    framed = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols
    ]
    return F.sha2(F.concat(*framed), 256)


def parse_int(col: Column) -> Column:
    """The leading whole number of a text, as JavaScript's parseInt reads it, or null."""
    return F.regexp_extract(js_trim(col.cast("string")), r"^([+-]?\d+)", 1).try_cast("bigint")


def parse_float(col: Column) -> Column:
    """The leading decimal number of a text, as JavaScript's parseFloat reads it, or null."""
    pattern = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.regexp_extract(js_trim(col.cast("string")), pattern, 1).try_cast("double")


def to_fixed(col: Column, digits: int) -> Column:
    """A number with `digits` decimals, rounded from its exact binary value as JavaScript does.

    format_number rounds that value, but an exact half to even instead of up. A double lies
    exactly halfway if it is an odd multiple of 2 ** -(digits + 1).
    """
    number = col.cast("double")
    scaled = F.abs(number) * F.lit(float(2 ** (digits + 1)))
    halfway = (scaled % 2) == 1
    exact = F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))
    return F.when(halfway, F.format_string(f"%.{digits}f", number)).otherwise(exact)


def to_exponential(col: Column, digits: int) -> Column:
    """Scientific notation with the exponent unpadded (5.00e-5)."""
    padded = F.format_string(f"%.{digits}e", col.cast("double"))
    return F.regexp_replace(padded, r"e([+-])0(\d)$", "e$1$2")


def generated_file_name(made: Column) -> Column:
    """The file of a set of variations, by the time they were made (UTC)."""
    utc = F.to_utc_timestamp(made, F.current_timezone())
    stamp = F.date_format(utc, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")
    return F.concat(F.lit("generated_"), stamp, F.lit(fixed.PAIR_FILE_SUFFIX))


def report_file_name(model: Column, quantization: Column, kind: str) -> Column:
    """`kind` is report or judge."""
    return F.concat(model, F.lit("-"), quantization, F.lit(f"-{kind}.json"))


def repo_file_name(repo: str) -> str:
    return re.sub("/", "_", repo) + fixed.PAIR_FILE_SUFFIX


# No text written before this process can hold this.
_END = uuid.uuid4().hex


def evaluated(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Adds a costly column that is worked out once per row.

    A plain column would be worked out again in every expression and filter it is used in.
    """
    return df.select("*", F.explode(F.array(col)).alias(name))


# The parser behind try_parse_json takes no text value of more characters.
_PARSED = 20_000_000
# from_json with the strictness of try_parse_json, and no cap on a text value.
_STRICT = {"maxStringLen": str(2**31 - 1), "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def _listed(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))


def _is_long(text: Column) -> Column:
    return F.coalesce(F.octet_length(text) > _PARSED, F.lit(False))


def _oversized(text: Column) -> Column:
    """Whether a long text is exactly one JSON value, for texts that gave no VARIANT."""
    parts = F.transform(F.array(F.from_json(_listed(text), "array<string>", _STRICT)), lambda p: (F.size(p) == 2) & (p[1] == _END))
    return _is_long(text) & F.coalesce(parts[0], F.lit(False))


def with_json(df: DataFrame, name: str, text: Column, oversized: bool = False) -> DataFrame:
    """Adds a text as VARIANT, or null if it is not exactly one JSON value.

    The parser stops after the first value, so the text is parsed as the first item of a list
    whose second item is known: anything after the value breaks or displaces that item. A VARIANT
    holds up to 128 MiB. A value beyond that fails the job, or is null with `oversized`, for
    callers that read it with `with_json_texts`.
    """
    listed = F.when(_is_long(text), F.from_json(_listed(text), "variant", _STRICT)).otherwise(F.try_parse_json(_listed(text)))
    whole = F.try_variant_get("_listed", "$[1]", "string") == _END
    value = F.when(whole, F.try_variant_get("_listed", "$[0]", "variant"))
    if not oversized:
        value = value.when(F.col("_listed").isNull() & _oversized(text), F.raise_error(F.lit("a JSON value of more than 128 MiB as VARIANT")))
    return evaluated(evaluated(df, "_listed", listed), name, value).drop("_listed")


def with_json_texts(df: DataFrame, name: str, parsed: Column, text: Column, fields: list[str]) -> DataFrame:
    """Adds a struct with `fields` of a JSON object as texts if it is beyond a VARIANT, else null.

    `parsed` is what `with_json` gave. Numbers, lists and objects are shown as compact JSON.
    """
    schema = "struct<" + ", ".join(f"`{f}`:string" for f in fields) + ">"
    is_object = F.btrim(F.substring(text, 1, 1000), F.lit(" \t\r\n")).startswith("{")
    return evaluated(df, name, F.when(parsed.isNull() & is_object & _oversized(text), F.from_json(text, schema, _STRICT)))

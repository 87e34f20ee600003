"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language in order. A document's own list is
compared with each profile: every n-gram costs the difference of its two places, or the length
of the profile if it is not there. The language with the smallest sum wins.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairworks.llm.common import map_batches

LONGEST = 3
PROFILE = 400
UNDETERMINED = "und"
FEWEST_FOR_LEAST = 200
MOST_AT_ONCE = 512  # texts; with every letter there is, their n-grams' numbers stay below 2 ** 63
BYTES_AT_ONCE = 1_000_000  # of texts; the arrays of their n-grams take some dozens of times as much
_BITS = 21  # of a code point; three of them and no more fit into a key


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 (a gap between words) if it is no letter."""
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(alphabet, number) of every n-gram of 1 to LONGEST characters of words with a gap on either side.

    The alphabet is the gap and the letters of these texts in their order, b of them. A number has the
    places of up to three characters there as its digits to the base b, and the text's number before
    them. So numbers are in the order of texts and keys, and small enough to be sorted by themselves.
    """
    flat = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    chars = _letters()[flat]
    # One gap between words is enough.
    keep = np.r_[True, (chars[1:] > 0) | (chars[:-1] > 0)]
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    b = len(alphabet)
    kind = np.int32 if max(len(texts), 1) * b ** LONGEST < 2 ** 31 else np.int64
    place = np.zeros(len(seen), kind)
    place[alphabet] = np.arange(b)
    # The gap after a text is its own, the one before the first text the first one's.
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=kind) * kind(b ** LONGEST), lengths)
    owner, char = np.r_[kind(0), owner][:len(flat)][keep], place[chars[keep]]
    letter = char > 0
    two = char[:-1] * kind(b) + char[1:]
    three = owner[1:-1] + two[:-1] * kind(b) + char[2:]
    # An n-gram belongs to the text of its last letter; none has a gap within.
    return alphabet, np.concatenate([(owner + char)[letter], owner[1:] + two, three[letter[1:-1]]])


def _keys(alphabet: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of numbers."""
    b = len(alphabet)
    rest, last = np.divmod(number.astype(np.int64), b)
    rest, middle = np.divmod(rest, b)
    owner, first = np.divmod(rest, b)
    return owner, (alphabet[first] << _BITS | alphabet[middle]) << _BITS | alphabet[last]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of every n-gram of 1 to LONGEST characters of words with a gap on either side."""
    return _keys(*_numbered(texts))


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, count), sorted by text, then count from the highest, then key."""
    if len(texts) > MOST_AT_ONCE:
        parts = [(start, *_counts(texts[start:start + MOST_AT_ONCE])) for start in range(0, len(texts), MOST_AT_ONCE)]
        return tuple(map(np.concatenate, zip(*((owner + start, key, count) for start, owner, key, count in parts), strict=True)))
    alphabet, number = _numbered(texts)
    number, count = _run_lengths(number)
    owner, key = _keys(alphabet, number)
    if not len(count):
        return owner, key, count
    # The text, the count from the highest and the place make up one number again, if it is not too large.
    most, places = int(count.max()), len(number)
    if len(texts) * (most + 1) * places < 2 ** 63:
        order = np.sort((owner * (most + 1) + most - count) * places + np.arange(places)) % places
    else:
        order = np.lexsort((key, -count, owner))
    return owner[order], key[order], count[order]


def _run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each is there."""
    values = np.sort(values)
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.r_[at, len(values)])


@dataclass
class Profiles:
    languages: list[str]
    keys: np.ndarray  # all keys of any profile, sorted
    places: np.ndarray  # a row per key and a column per language; PROFILE where the key is missing

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and 1 less its distance as a share of the largest possible."""
        owner, key, _ = _counts(texts)
        starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        place = np.arange(len(owner)) - starts[owner] if len(owner) else owner
        top = place < PROFILE
        owner, key, place = owner[top], key[top], place[top]
        sizes = np.bincount(owner, minlength=len(texts))
        n = len(self.languages)
        if not n:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = (self.keys[at] == key)[:, None]
        theirs = np.where(hit, self.places[at], PROFILE)
        cost = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - place[:, None]))
        total = np.column_stack([np.bincount(owner, cost[:, k], len(texts)) for k in range(n)])
        best = total.argmin(axis=1)
        share = 1 - total[np.arange(len(texts)), best] / np.maximum(sizes * PROFILE, 1)
        return ([self.languages[b] if size else UNDETERMINED for b, size in zip(best, sizes, strict=True)],
                np.where(sizes > 0, share, 0.0))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all rows with a text and a language; a row that repeats counts as often.

    N-grams are counted per batch and language before the shuffle, so that a hot language
    shuffles no more than the others. Equal counts are put in the order of their keys. The
    profiles, at most PROFILE rows per language, are all that reaches the driver.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        langs, keys, counts = [], [], []
        for lang, some in texts.items():
            # As one text: the gaps between them keep their words apart.
            alphabet, number = _numbered(["\0".join(some)])
            number, count = _run_lengths(number)
            langs += [lang] * len(count)
            keys.append(_keys(alphabet, number)[1])
            counts.append(count)
        join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), join(keys), join(counts)], ["lang", "key", "n"])

    rows = docs.select(F.col(lang_col).cast("string"), F.col(text_col)).filter(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = map_batches(rows, run, "lang string, key long, n long", rows=2000, size=BYTES_AT_ONCE).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    best = counted.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < PROFILE).collect()
    languages = sorted({row.lang for row in best})
    keys = np.array(sorted({row.key for row in best}), np.int64)
    places = np.full((len(keys), len(languages)), PROFILE, np.int64)
    for row in best:
        places[np.searchsorted(keys, row.key), languages.index(row.lang)] = row.place
    return Profiles(languages, keys, places)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row, by the whole text and nothing else.

    A null text or one without a letter is `und` with score 0. Equal distances go to the language
    whose name comes first. Null and repeated ids stay, other columns are not read, an empty
    table gives an empty one, and without any profile every row is `und`.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = profiles.predict([text or "" for text in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          [id_col, "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, schema, rows=256, size=BYTES_AT_ONCE)


def _length_class(text: str) -> int:
    """Scores depend on the length of a text: each doubling is a class of its own."""
    return len(text).bit_length()


def learn_least_scores(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang",
                       fewest: int = FEWEST_FOR_LEAST) -> dict[tuple[str, int], float]:
    """The least score that a text of a language and length class should reach, from rows with a language
    that the profiles have not been learnt from.

    It lies as far below the lowest score that was seen as half the way from there to the median;
    a class with fewer than `fewest` rows has none. Rows that look like another language than theirs
    do not count. At most one row per language and class reaches the driver.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column(1).to_pylist()]
        langs, scores = profiles.predict(texts)
        own = pa.array([a == b for a, b in zip(langs, batch.column(0).to_pylist(), strict=True)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(_length_class, texts)), pa.int32()), pa.array(scores, pa.float64())],
                                          ["lang", "class", "score"]).filter(own)

    rows = docs.select(F.col(lang_col).cast("string"), F.col(text_col)).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen = map_batches(rows, run, "lang string, class int, score double", rows=256, size=BYTES_AT_ONCE).groupBy("lang", "class").agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.percentile_approx("score", 0.5, 1000).alias("middle"))
    return {(r["lang"], r["class"]): r["low"] - (r["middle"] - r["low"]) / 2 for r in seen.filter(F.col("n") >= fewest).collect()}


def accepted(docs: DataFrame, profiles: Profiles, least: dict[tuple[str, int], float] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text fits a language.

    That is: not `und`, with an n-gram of its profile, and with at least the score that `least` has
    for its language and length class, if any. How large a score gets depends on the script and the
    length as much as on the language, so that no one number decides. All columns stay as they are,
    repeated rows stay or go together, and no row is moved.
    """
    at = docs.columns.index(text_col)
    least = least or {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column(at).to_pylist()]
        langs, scores = profiles.predict(texts)
        fits = [lang != UNDETERMINED and score > 0 and score >= least.get((lang, _length_class(text)), 0.0)
                for lang, score, text in zip(langs, scores, texts, strict=True)]
        return batch.filter(pa.array(fits, pa.bool_()))

    return map_batches(docs, run, docs.schema, rows=256, size=BYTES_AT_ONCE)


def learn_and_identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: id, held_out, lang_pred, score.

    A row whose `held_out` is null, as with a null id, is held out; repeated rows are learnt from, and
    come back, as often as they are there.
    """
    out = F.coalesce(held_out, F.lit(True))
    profiles = learn(docs.filter(~out), text_col, lang_col)
    return identify(docs, profiles, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")

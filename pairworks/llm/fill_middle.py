"""Fill-in-the-middle training texts, cut at code points of UTF-8 without decoding it.

The texts of a batch lie in one buffer of bytes. A sparse index names the characters of more than
one byte and the excess bytes up to each; between them a code point and a byte are one step apart.
A binary search in the index turns places in bytes into places in code points and back, so that
plain ASCII costs no work per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.llm.common import map_batches

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class CharIndex:
    """Places of multibyte characters in UTF-8 bytes: code points and bytes into each other."""

    def __init__(self, data: np.ndarray):
        self._starts = np.flatnonzero(data >= 0xC0)
        first = data[self._starts]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self._excess = np.r_[0, np.cumsum(excess)]
        self._chars = self._starts - self._excess[:-1]

    def char_at(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte at which a character starts, or the data ends."""
        return byte - self._excess[np.searchsorted(self._starts, byte)]

    def byte_at(self, char: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return char + self._excess[np.searchsorted(self._chars, char)]


def _bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts in one piece, and where each starts and the last ends; a null text is empty."""
    parts = [text.encode("utf-8") if text else b"" for text in texts.to_pylist()]
    return b"".join(parts), np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]


def _numbers(id_col: str, seed: str) -> list[Column]:
    """Four numbers of 32 bits out of the seed and a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (code points), form, prefix_chars, middle_chars, output.

    A text is cut in three at two places that follow from the seed and the id, and put together
    as prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each after its mark.
    `plain_percent` of the rows stay as they are, and so do empty texts and texts that hold a
    mark; their prefix_chars and middle_chars are null. A null text is empty, a null id counts
    as an empty one, repeated rows come out alike, other columns are not read, and an empty table
    gives an empty one. Nothing is shuffled; a task holds the texts of one batch.
    """
    marks = [mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE)]
    schema = (f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n long, form string, "
              "prefix_chars long, middle_chars long, output string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = _bytes(batch.column(1))
        h1, h2, h3, h4 = (batch.column(2 + i).to_numpy() for i in range(4))
        index = CharIndex(np.frombuffer(data, np.uint8))
        begin = index.char_at(at)
        n, begin = np.diff(begin), begin[:-1]
        one, two = h1 % (n + 1), h2 % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        first, second = index.byte_at(begin + low), index.byte_at(begin + high)
        outputs, forms = [], []
        for i in range(batch.num_rows):
            text = data[at[i]:at[i + 1]]
            if not text or h3[i] % 100 >= 100 - plain_percent or any(mark in text for mark in marks):
                forms.append(PLAIN)
                outputs.append(text)
                continue
            prefix, middle, suffix = data[at[i]:first[i]], data[first[i]:second[i]], data[second[i]:at[i + 1]]
            if h4[i] % 100 < spm_percent:
                forms.append(SPM)
                outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle)))
            else:
                forms.append(PSM)
                outputs.append(b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle)))
        plain = np.array([form == PLAIN for form in forms], bool)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=plain),
             pa.array(high - low, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
            [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col), *_numbers(id_col, seed)), run, schema, rows=256)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, by its form and the marks in it alone.

    A cut text holds no mark, and no mark begins like the end of another, so that the first of
    each kind is the one that was put there.
    """
    ahead = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.length(ahead) + F.lit(len(MIDDLE) + 1))

    def parts(opening: str, closing: str) -> tuple[Column, Column]:
        one = F.substring_index(ahead, closing, 1)
        return F.substr(one, F.lit(len(opening) + 1)), F.substr(ahead, F.length(one) + F.lit(len(closing) + 1))

    (prefix, suffix), (suffix_first, prefix_second) = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(prefix, middle, suffix)).otherwise(
        F.concat(prefix_second, middle, suffix_first))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fill_in_middle with digests of the outputs and of the texts restored from them."""
    made = fill_in_middle(docs, id_col=id_col, text_col=text_col)
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))

"""Byte-level BPE by a sentencepiece model that is written out from a table of ranks.

Every byte is mapped to a printable character, every token of the table becomes a piece of such
characters with the negative rank as its score, and nothing is normalised. Sentencepiece then
merges the pair with the best score, the leftmost first, which is the order of ranks. Texts are
split by the pattern first and each match is encoded apart. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairworks.llm.common import Remembered, map_batches

# Field numbers of sentencepiece's ModelProto and the kinds of pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2
_MODEL_TYPE, _UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 3, 40, 41, 42, 43
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5

_SPACE_AND_MORE = re.compile(r" (?=\S)")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _data(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks must be consecutive from 0")
    return [token for _, token in pairs]


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; one unknown piece follows them."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _data(_PIECES, _data(_PIECE, piece) + _float(_SCORE, -float(rank)) + _number(_TYPE, _NORMAL))
    out += _data(_PIECES, _data(_PIECE, b"<unk>") + _float(_SCORE, 0.0) + _number(_TYPE, _UNKNOWN))
    out += _data(_TRAINER, _number(_MODEL_TYPE, _BPE) + _number(_UNK_ID, len(tokens))
                 + _number(_BOS_ID, -1) + _number(_EOS_ID, -1) + _number(_PAD_ID, -1))
    out += _data(_NORMALIZER, _data(_NAME, b"identity") + _number(_DUMMY_PREFIX, 0)
                 + _number(_EXTRA_SPACES, 0) + _number(_ESCAPE_SPACES, 0))
    return bytes(out)


class ByteBpe:
    """Encodes texts to little-endian 32-bit ids and decodes them to bytes."""

    def __init__(self, path: str, pattern: str):
        chars = byte_characters()
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model_proto(read_ranks(path)))
        self._split = regex.compile(pattern).findall
        self._mapped = dict(enumerate(chars))
        byte_of = {ord(c): b for b, c in enumerate(chars)}
        n = self._pieces.get_piece_size() - 1
        back = [self._pieces.id_to_piece(i).translate(byte_of).encode("latin-1") for i in range(n)]
        self._lengths = np.fromiter(map(len, back), np.int64, n)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(back), np.uint8)
        # Parts by the pattern, and texts between spaces, which hold one or a few parts.
        self._parts = Remembered(self._encode_parts, entries=200_000)
        self._words = Remembered(self._encode_words)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        mapped = [part.encode().decode("latin-1").translate(self._mapped) for part in parts]
        return [np.array(ids, "<u4").tobytes() for ids in self._pieces.encode(mapped, num_threads=1)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [b"".join(ids) for ids in self._parts.look_up([self._split(word) for word in words])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Matches of the pattern hold a space only in front or among white
        space, so that a space before something else always starts a match: texts are cut there
        first, and the same pieces need not be split twice."""
        words = []
        for text in texts:
            cut = _SPACE_AND_MORE.split(text)
            words.append([cut[0], *[" " + word for word in cut[1:]]])
        return [b"".join(ids) for ids in self._words.look_up(words)]

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        lengths = self._lengths[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self._starts[numbers] - (ends - lengths), lengths)
        return self._bytes[at + np.arange(len(at))].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One per Python worker, as writing out and loading the model takes a moment."""
    return ByteBpe(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256.

    With `with_ids` and `with_text` also the ids (array of int) and the decoded bytes. `path` is a
    rank file and must exist on every executor. No row is moved: each task encodes the rows it
    reads. A null or empty text has no tokens and the digests of nothing; a null id stays; every
    row gives one row, repeated or not; other columns are not read, whatever their names; an
    empty table gives an empty one. A text is never cut.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded binary" * with_text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path, pattern)
        counts, digests, backs, ids_out, texts = [], [], [], [], []
        for ids in bpe.encode([text or "" for text in batch.column(1).to_pylist()]):
            decoded = bpe.decode(ids)
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            backs.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                ids_out.append(np.frombuffer(ids, "<u4").astype("i4"))
            if with_text:
                texts.append(decoded)
        columns = {id_col: batch.column(0), "n_tokens": pa.array(counts, pa.int64()),
                   "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(backs, pa.string())}
        if with_ids:
            columns["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
        if with_text:
            columns["decoded"] = pa.array(texts, pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_batches(df.select(F.col(id_col), F.col(text_col)), run, schema)

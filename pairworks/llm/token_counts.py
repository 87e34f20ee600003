"""Token counts of a sentencepiece BPE model by rank-synchronous merging of numpy arrays.

A text is cut where no merge can reach across: before a run of word-start marks, and around
characters that no piece holds; a long part also between two characters that no piece has side by
side. The parts of a batch lie one after the other in one array of piece ids. In each round every
part merges all places of its best-scored pair at once, from the left and without overlap; the
symbols that are left in the end are the tokens. Characters that no piece covers count as many
tokens as they have bytes.

A round costs as much as the part is long, so that rounds are for parts of up to LONG characters.
A longer part that has no place to cut keeps its pairs in a queue by rank and place instead.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairworks.llm.common import Remembered, map_batches

# Fixed values of the model format: field numbers, kinds of pieces and the mark for a space.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _USER_DEFINED, _BPE, _BYTE = 1, 4, 2, 6
_MODEL_TYPE, _SUFFIX_SPACES, _BYTE_FALLBACK = 3, 24, 35
_CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 2, 3, 4, 5
_SPACE = "▁"

_EDGES = re.compile(r"^ |  | \Z")
_NONE = np.iinfo(np.int64).max
LONG = 64
_BITS = 21  # of a code point


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield field, data[at:at + size]
            at += size


class PieceCounter:
    """Counts the tokens of texts by the model file at `path`."""

    def __init__(self, path: str):
        pieces, trainer, normalizer = [], {}, {}
        with open(path, "rb") as file:
            for field, value in _fields(file.read()):
                if field == _PIECES:
                    pieces.append(dict(_fields(value)))
                elif field == _TRAINER:
                    trainer = dict(_fields(value))
                elif field == _NORMALIZER:
                    normalizer = dict(_fields(value))
        kinds = [p.get(3, _NORMAL) for p in pieces]
        if (trainer.get(_MODEL_TYPE) != _BPE or trainer.get(_SUFFIX_SPACES, 0) or normalizer.get(_CHARSMAP)
                or not normalizer.get(_DUMMY_PREFIX, 1) or normalizer.get(_EXTRA_SPACES, 1)
                or not normalizer.get(_ESCAPE_SPACES, 1) or not trainer.get(_BYTE_FALLBACK, 0)
                or _USER_DEFINED in kinds):
            raise ValueError(f"{path}: only BPE with byte fallback and an identity normaliser is supported")
        names = [p[1].decode() for p, kind in zip(pieces, kinds, strict=True) if kind == _NORMAL]
        scores = np.array([struct.unpack("<f", p[2])[0] for p, kind in zip(pieces, kinds, strict=True) if kind == _NORMAL])
        # Equal scores share a rank; the leftmost pair goes first, as in the library.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        id_of = {name: i for i, name in enumerate(names)}
        pairs = sorted({(id_of[name[:k]] << 32 | id_of[name[k:]], i) for name, i in id_of.items()
                        for k in range(1, len(name)) if name[:k] in id_of and name[k:] in id_of})
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ids = np.array([i for _, i in pairs], np.int64)
        self._made = {key: (int(self.rank[i]), i) for key, i in pairs}
        beside = {ord(a) << _BITS | ord(b) for name in names for a, b in zip(name, name[1:])}  # noqa: B905
        self.beside = np.array(sorted(beside), np.int64)
        # A piece is unsafe if it is part of a piece with a better rank: that pair would come first.
        self.unsafe = np.zeros(len(names), bool)
        for key, whole in pairs:
            for part in (key >> 32, key & 0xFFFFFFFF):
                self.unsafe[part] |= self.rank[whole] <= self.rank[part]
        singles = {ord(name): i for name, i in id_of.items() if len(name) == 1}
        self.char_codes = np.array(sorted(singles), np.int64)
        self.char_ids = np.array([singles[c] for c in sorted(singles)], np.int64)
        joined = "\n".join(names)
        # Nothing merges across a mark that follows another character, if no piece holds that.
        whole = re.search(f"[^{_SPACE}\n]{_SPACE}", joined) is not None
        # Control characters without a piece, such as line ends, are parts of their own.
        self.alone = "".join(chr(c) for c in (*range(32), 127) if chr(c) not in id_of
                             and not any(chr(c) in name for name in names))
        alone = re.escape(self.alone)
        rest = f"[^{_SPACE}{alone}]"
        self._split = re.compile(r"(?s).+" if whole else
                                 f"{_SPACE}*{rest}+|{_SPACE}+" + (f"|[{alone}]+" if alone else "")).findall
        self._one_part = whole
        self._runs = re.compile(f"(?s){_SPACE}+[^{_SPACE}]*").findall
        # Counts of texts between spaces; each stands for itself with a mark before it.
        self._counts = Remembered(lambda words: self._count_words([_SPACE + word for word in words]))

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def count_parts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part."""
        long = [i for i, part in enumerate(parts) if len(part) > LONG]
        if not long:
            return self._count_short(parts)
        total = np.zeros(len(parts), np.int64)
        owners, short = [], []
        for i, part in enumerate(parts):
            for piece in self._cut(part) if len(part) > LONG else (part,):
                if len(piece) > LONG:
                    total[i] += self._count_long(piece)
                else:
                    owners.append(i)
                    short.append(piece)
        for start in range(0, len(short), 50_000):
            some = short[start:start + 50_000]
            np.add.at(total, owners[start:start + len(some)], self._count_short(some))
        return total

    def _cut(self, part: str) -> list[str]:
        """A part in pieces between which no merge is possible, as no piece has the two characters side by side."""
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pairs = codes[:-1] << _BITS | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        cuts = (np.flatnonzero(self.beside[at] != pairs) + 1).tolist()
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]

    def _count_long(self, part: str) -> int:
        """Tokens of a part without a place to cut: the best pair first, of equal ones the leftmost."""
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        known = self.char_codes[at] == codes
        ids = np.where(known, self.char_ids[at], -1).tolist()
        n, made = len(ids), self._made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(new[0], i, new[1]) for i in range(n - 1)
                 if ids[i] >= 0 and ids[i + 1] >= 0 and (new := made.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(queue)
        left = int(known.sum())
        while queue:
            _, i, piece = heapq.heappop(queue)
            j = after[i]
            # A pair that is no longer there has a symbol that has changed or gone.
            if ids[i] < 0 or j >= n or ids[j] < 0 or made.get(ids[i] << 32 | ids[j], (0, -1))[1] != piece:
                continue
            ids[i], ids[j] = piece, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if ids[k] >= 0 and (new := made.get(piece << 32 | ids[k])):
                    heapq.heappush(queue, (new[0], i, new[1]))
            h = before[i]
            if h >= 0 and ids[h] >= 0 and (new := made.get(ids[h] << 32 | piece)):
                heapq.heappush(queue, (new[0], h, new[1]))
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        return left + int(width[~known].sum())

    def _count_short(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part, all parts merged side by side."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), lengths)
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        known = self.char_codes[at] == codes
        ids = np.where(known, self.char_ids[at], -1)
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        total = np.bincount(owner, np.where(known, 0, width), len(parts)).astype(np.int64)
        while len(ids):
            made = np.full(len(ids), -1)
            made[:-1] = np.where(owner[:-1] == owner[1:], self._pair(ids[:-1], ids[1:]), -1)
            rank = np.where(made >= 0, self.rank[made], _NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(owner)]))
            best = np.minimum.reduceat(rank, starts)
            # What has no pair left is counted and goes.
            going = best < _NONE
            total += np.bincount(owner, (ids >= 0) & ~going[group], len(parts)).astype(np.int64)
            hit = (rank == best[group]) & going[group]
            # Of overlapping places in a run every second one stays, from the left.
            spot = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, (np.diff(spot) != 1) | (owner[spot][1:] != owner[spot][:-1])]) - 1 \
                if len(spot) else spot
            first = spot[np.flatnonzero(np.r_[True, np.diff(run) != 0])] if len(spot) else spot
            spot = spot[(spot - first[run]) % 2 == 0] if len(spot) else spot
            # A part with an unsafe piece among them takes only its leftmost place this round.
            if len(spot):
                risky = np.unique(owner[spot][self.unsafe[made[spot]]])
                lead = np.r_[True, np.diff(owner[spot]) != 0]
                spot = spot[lead | ~np.isin(owner[spot], risky)]
            ids[spot] = made[spot]
            keep = going[group]
            keep[spot + 1] = False
            ids, owner = ids[keep], owner[keep]
        return total

    def _count_words(self, words: list[str]) -> list[int]:
        """Tokens of marked texts. Each is cut into parts that are merged apart."""
        parts = [self._split(word) for word in words]
        flat = [part for some in parts for part in some]
        counts = np.zeros(len(flat) + 1, np.int64)
        for start in range(0, len(flat), 50_000):
            some = flat[start:start + 50_000]
            counts[start + 1:start + 1 + len(some)] = self.count_parts(some)
        ends = np.cumsum([0, *map(len, parts)])
        total = np.cumsum(counts)
        return (total[ends[1:]] - total[ends[:-1]]).tolist()

    def count_texts(self, texts: list[str]) -> list[int]:
        words = []
        for text in texts:
            marked = text.replace(" ", _SPACE)
            if self._one_part:
                words.append([marked] if text else [])
            elif text and _SPACE not in text and not _EDGES.search(text):
                words.append(text.split(" "))
            else:
                words.append([run[1:] for run in self._runs(_SPACE + marked)] if text else [])
        return [sum(counts) for counts in self._counts.look_up(words)]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: n_bytes (UTF-8), n_tokens without special tokens, over_limit (more than `limit`).

    `path` is a sentencepiece model that must exist on every executor. Nothing is moved. A null or
    empty text has no bytes and no tokens; null and repeated ids stay, one row each; other columns
    are not read; an empty table gives an empty one. The whole text counts, and the work grows with its
    length, whether or not it has spaces.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text or "" for text in batch.column(1).to_pylist()]
        counts = counter(path).count_texts(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
             pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
            [id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(df.select(F.col(id_col), F.col(text_col)), run, schema)

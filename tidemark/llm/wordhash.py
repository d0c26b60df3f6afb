"""Vectorised word and shingle hashing over Arrow string arrays.

A word is hashed from its bytes with a polynomial whose prefix sums give every
word's hash without a loop over words; A-Z count as a-z.  Kinds of words:
``space`` (runs without ASCII white space), ``alnum`` (runs of ASCII letters,
digits and bytes of other characters), ``letters`` (the same without digits)
and ``piece`` (runs without white space and the signs that end a piece).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(0x1234567))
_EXACT = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))
_KINDS = {"space": np.ones(256, bool), "alnum": np.zeros(256, bool), "letters": np.zeros(256, bool), "piece": np.ones(256, bool)}
_KINDS["space"][[9, 10, 11, 12, 13, 32]] = False
_KINDS["alnum"][[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS["letters"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes that end a piece of text.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_KINDS["piece"][PIECE_ENDS] = False
_KINDS["piece"][[9, 32]] = False


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0], _powers[1]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and the last ends; null is empty."""
    array = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


class Spans:
    """Hashes of any spans of some bytes; with ``fold``, A-Z count as a-z."""

    def __init__(self, data: np.ndarray, fold: bool = True):
        power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_VALUE if fold else _EXACT)[data] * power[: len(data)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of every text, in order: hashes, the rows they stand in, and where they start and end in the bytes of all."""

    def __init__(self, texts: pa.Array, kind: str):
        self.data, offsets = flat(texts)
        data = self.data
        if not len(data):
            self.starts = self.ends = self.rows = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            return
        inside = _KINDS[kind][data]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.hashes = Spans(data).hashes(self.starts, self.ends)
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of UTF-8 bytes as strings."""
    size = ends - starts
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    places = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places])))


def hashed_words(texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte, end byte) of every word of every text, in order."""
    words = Words(texts, kind)
    return words.hashes, words.rows, words.starts, words.ends


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words."""
    out = words[: max(0, len(words) - n + 1)]
    for k in range(1, n):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[k : k + len(out)])
    return out


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-word shingles of each text; a text of 1 to n-1 words gives one from all of them."""
    if not len(words):
        return words, rows
    full = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :]) if len(rows) >= n else np.zeros(0, np.int64)
    hashes, at = chained(words, n)[full], rows[full]
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[firsts, len(rows)])
    short = np.flatnonzero(counts < n)
    if not len(short):
        return hashes, at
    extra = np.array([chained(words[f : f + c], c)[0] ^ np.uint64(0xA5A5A5A5 + c) for f, c in zip(firsts[short].tolist(), counts[short].tolist(), strict=True)], np.uint64)
    hashes, at = np.r_[hashes, extra], np.r_[at, rows[firsts[short]]]
    order = np.argsort(at, kind="stable")
    return hashes[order], at[order]


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows' values begin in the ascending array rows, and where the last end."""
    return np.searchsorted(rows, np.arange(n + 1))

"""Vectorised words and word hashes over a batch of texts.

A word is a longest run of ASCII letters, digits, underscores and non-ASCII characters, taken in
lower case. Hashes are 64 bits wide, equal in every process and on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n at least."""
    while len(_powers[0]) <= n:
        k = len(_powers[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * U(pow(base, k, 1 << 64))])
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of some texts: text i owns the words first[i] to first[i + 1] - 1."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hashes of byte ranges, of the words by default."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        return mix((self.sums[ends] - self.sums[starts]) * _grown(len(self.data))[1][starts] + (ends - starts).astype(U))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column on end, and each text's first position and the end; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def words(column: pa.Array) -> Words:
    """The words of each text."""
    return words_of(*raw_bytes(pc.utf8_lower(pc.fill_null(column, ""))))


def windows(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, Words]]:
    """(position of its first byte, words) of stretches of about most bytes, parted between words, so that a very long text never has all its arrays at once.

    Texts are numbered as in the column in every stretch.
    """
    data, offsets = raw_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    at = 0
    while True:
        to = min(at + most, len(data))
        while to < len(data) and _WORD[data[to - 1]]:  # on to the end of a word, a stretch at a time
            ends = np.flatnonzero(~_WORD[data[to : to + (1 << 16)]])
            to = to + int(ends[0]) + 1 if len(ends) else min(to + (1 << 16), len(data))
        yield at, words_of(data[at:to], np.clip(offsets - at, 0, to - at))
        at = to
        if at >= len(data):
            return


@dataclass
class WordHashes:
    """The word hashes of some texts, without the texts."""

    first: np.ndarray
    values: np.ndarray

    def hashes(self) -> np.ndarray:
        return self.values


def word_hashes(column: pa.Array) -> WordHashes:
    """Word hashes of each text, made stretch by stretch."""
    first, values = np.zeros(len(column) + 1, np.int64), []
    for _, found in windows(column):
        first += found.first
        values.append(found.hashes())
    return WordHashes(first, np.concatenate(values))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts that lie end to end."""
    inside = _WORD[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else np.zeros(0, bool)
    after = np.concatenate([inside[1:], [False]]) if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    power, _ = _grown(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), sums)


def text_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each raw text, 128 bits in all."""
    data, offsets = raw_bytes(column)
    power, inverse = _grown(len(data))
    out = []
    for seed in (1, 2):
        table = mix(_BYTE + U(seed))
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(table[data] * power[: len(data)], out=sums[1:])
        out.append(mix((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]] + np.diff(offsets).astype(U)))
    return out[0], out[1]


def shingles(found: Words | WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of width words; a text of fewer words has one run of all its words."""
    h = found.hashes()
    n = np.diff(found.first)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U)
    runs = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), runs)
    start = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.arange(runs.sum()) - np.repeat(start, runs) + np.repeat(found.first[:-1], runs)
    held = np.minimum(n[owner], width)
    acc = mix(held.astype(U))
    for j in range(width):
        inside = held > j
        nxt = h[np.minimum(at + j, len(h) - 1)]
        acc = np.where(inside, mix(acc) + nxt, acc)
    return owner, mix(acc)

"""Hashes of the words of many texts at once, straight from Arrow's buffers.

A word's hash is a polynomial of its bytes modulo the prime 2^61 - 1, mixed with
its length. It is the difference of two running sums, scaled by an inverse
power, so numpy computes all words of a batch without a loop over words. Modulo
a prime two given strings of n bytes share a value in fewer than n of its bases;
modulo 2^64, some share theirs in every base.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = 0x9E3779B97F4A7C15 % PRIME
#: Bytes hashed in one go; a piece ends between two words.
PIECE = 1 << 20
#: Longer words are hashed one by one: so sums of bytes times half a power stay below 2^64.
LONG = 1 << 16

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_1, _30, _31, _61 = (np.uint64(n) for n in (1, 30, 31, 61))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, from below 2^64."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of factors below it."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = ah * bl + al * bh
    # 2^61 counts as 1: the high product stands at 2^62, the middle one at 2^31.
    return reduced(((ah * bh) << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + al * bl)


class Powers:
    """Powers of a base and of its inverse modulo the prime, as many as have been asked for."""

    def __init__(self, base: int = _BASE):
        self.bases = base % PRIME, pow(base, -1, PRIME)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, times(t, np.uint64(pow(b, m, PRIME)))]) for t, b in zip(self.tables, self.bases)]
        return self.tables[0][:n], self.tables[1][:n]

    def sums(self, values: np.ndarray, small: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of values times powers, from 0, as sums of their low 31 bits and of the rest; ``small`` values are bytes."""
        power = self(len(values))[0]
        if small:
            low, high = values * (power & _LOW31), values * (power >> _31)
        else:
            product = times(reduced(values), power)
            low, high = product & _LOW31, product >> _31
        out = np.zeros((2, len(values) + 1), np.uint64)
        np.cumsum(low, out=out[0, 1:])
        np.cumsum(high, out=out[1, 1:])
        return out[0], out[1]

    def hashes(self, sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Of the values in [start, stop), wherever they stand."""
        low, high = (reduced(s[stops] - s[starts]) for s in sums)
        value = reduced(low + times(high, np.uint64(1 << 31)))
        return mix(times(value, self(len(sums[0]))[1][starts]) + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_powers = Powers()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text begins and the last ends), null as empty."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in a row, where each text's words begin and the last ones end).

    Words are what white space (space, 9-13) parts. Null counts as empty.
    """
    if len(texts) == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    flat, offsets = _bytes(texts)
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    word = ~_WHITE[flat]
    before = np.empty(len(flat), bool)
    before[1:] = word[:-1]
    before[:1] = False
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(flat), bool)
    after[:-1] = word[1:]
    after[-1:] = False
    stops = np.flatnonzero(word & (~after | edge[1:])) + 1
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(stops - starts > LONG)
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(flat[starts[i] : stops[i]], digest_size=8).digest(), "little")
    # Pieces of the words between long ones.
    for first, last in zip([0, *(long + 1).tolist()], [*long.tolist(), len(starts)]):
        at = first
        while at < last:
            upto = min(last, max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, "right"))))
            begin = starts[at]
            sums = _powers.sums(flat[begin : stops[upto - 1]].astype(np.uint64), small=True)
            out[at:upto] = _powers.hashes(sums, starts[at:upto] - begin, stops[at:upto] - begin)
            at = upto
    return out, np.searchsorted(starts, offsets)

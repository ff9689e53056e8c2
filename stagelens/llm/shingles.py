"""Vectorised word and shingle hashing over blocks of UTF-8 text (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)  # a random odd value for each byte
_MULT = (int(_rng.integers(1, 2**61)) * 8 + 5) % 2**64
_INVERSE = pow(_MULT, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = _BYTE.copy()
for _b in range(65, 91):  # A-Z hash as a-z, and no other letters are folded
    _BYTE[_b] = _BYTE[_b + 32]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_MULT, _INVERSE)):
            step = np.full(max(n, 1 << 16), np.uint64(x))
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_BYTE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span of bytes, case kept."""
    power, inverse = _power(len(data))
    out = []
    for table in (_EXACT, _BYTE_2):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data] * power, out=total[1:])
        out.append(mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
    return out[0], out[1]


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (runs of anything but space and \\x09-\\x0D, A-Z lower-cased), and for each
    row the index of its first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power, out=total[1:])
    words = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return words, np.searchsorted(begin, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `size` words; the whole sequence as one where
    there are fewer words; empty without words."""
    words, at = word_hashes(offsets, data)
    out = []
    if len(words) >= size:
        many = len(words) - size + 1
        rolled = words[:many] * _PLACE[0]
        for i in range(1, size):
            rolled += words[i : i + many] * _PLACE[i]
        rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(rolled[a : b - size + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[16 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Hashes of word shingles for whole Arrow batches, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is a group of its own.
GROUP_BYTES = 2_000_000
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_SIGNS = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(20240502).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A prime modulus beside 2**64: texts made to collide modulo a power of two do not here.
_PRIME = np.uint64((1 << 31) - 1)
_BITS = np.uint64(31)
_ROOT_P = 1_103_515_245
_SIGNS_P = np.random.default_rng(20240503).integers(1, int(_PRIME), 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash's root and of its inverse, grown as longer groups come."""

    def __init__(self):
        self.up = self.down = self.up_p = self.down_p = np.ones(1, dtype=np.uint64)

    def modulo_prime(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same modulo the prime."""
        while len(self.up_p) < n:
            m = len(self.up_p)
            more = (pow(x, m, int(_PRIME)) for x in (_ROOT_P, pow(_ROOT_P, -1, int(_PRIME))))
            self.up_p, self.down_p = (np.r_[x, x * np.uint64(y) % _PRIME] for x, y in zip((self.up_p, self.down_p), more, strict=True))
        return self.up_p[:n], self.down_p[:n]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP_BYTES)
            up, down = np.full(size, _ROOT), np.full(size, _BACK)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


def groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row borders of runs of texts of about GROUP_BYTES; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    borders = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + GROUP_BYTES, side="right")) - 1)
        yield at, data[borders[at] : borders[to]], borders[at : to + 1] - borders[at]
        at = to


def word_hashes(data: np.ndarray, borders: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, split at ASCII white space) and its text's row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = borders[(borders > 0) & (borders < len(data))]
    first[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:]
    last[inner - 1] = ~space[inner - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers.upto(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    low = _LOWER[data]
    np.cumsum(_SIGNS[low] * up, out=total[1:])
    first = mix((total[ends] - total[begins]) * down[begins])
    up, down = powers.modulo_prime(len(data))
    signs = _SIGNS_P[low] * up
    np.cumsum((signs & _PRIME) + (signs >> _BITS), out=total[1:])
    second = (total[ends] - total[begins]) % _PRIME * down[begins] % _PRIME
    return mix(first + mix(second)), np.searchsorted(borders, begins, side="right") - 1


def shingle_sets(column: pa.Array, k: int, powers: Powers) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; under k words: the whole as one."""
    for _, data, borders in groups(column):
        words, row = word_hashes(data, borders, powers)
        rows = len(borders) - 1
        at = np.searchsorted(row, np.arange(rows + 1))
        sums = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
        for j in range(k):
            sums += words[j : j + len(sums)] * _PLACES[j]
        sums = mix(sums)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(sums[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + _PLACES[32 + b - a])
            else:
                yield np.zeros(0, np.uint64)

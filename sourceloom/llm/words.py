"""Vectorised word hashing over UTF-8 bytes.

A word is a longest run of ASCII digits, ASCII letters (lower-cased) and bytes
over 0x7F.  Words are hashed to 64 bits with a polynomial over random byte
codes, taken from prefix sums, so that no Python code runs per word.  Such a
polynomial has known collisions between long strings, so words of more than
``LONG_WORD`` bytes get a cryptographic hash instead.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(20240607)
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

#: Bytes beyond which a word is hashed on its own.
LONG_WORD = 48
#: Powers that a worker keeps at most; a longer table lives for one call.
KEPT_POWERS = (1 << 20) + 1

_powers: dict[str, np.ndarray] = {}


def _table(which: str, base: int, n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2 ** 64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if len(have) <= KEPT_POWERS:
            _powers[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class SpanHasher:
    """Hashes of any byte spans of one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * _table("up", _BASE, n + 1)[:n], out=self._sums[1:])
        self._down = _table("down", _INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


class Words(NamedTuple):
    starts: np.ndarray  # byte positions in the chunk
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text: its first word; one more entry at the end
    lower: np.ndarray  # the chunk's bytes, lower-cased
    hasher: SpanHasher

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of set flags that stay inside one text."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = offs[(offs > 0) & (offs < n)]
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    begin[edges] |= flags[edges]
    end = flags.copy()
    end[:-1] &= ~flags[1:]
    end[edges - 1] |= flags[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """All words of the texts data[offs[i]:offs[i + 1]]; offs starts at 0."""
    starts, ends = runs(IS_WORD[data], offs)
    lower = LOWER[data]
    hasher = SpanHasher(lower)
    hashes = hasher(starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        hashes[long] = [int.from_bytes(hashlib.blake2b(lower[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return Words(starts, ends, hashes, np.searchsorted(starts, offs), lower, hasher)

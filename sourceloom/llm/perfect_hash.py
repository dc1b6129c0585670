"""A minimal perfect hash of 64-bit keys, built and used with numpy.

Each level is a bit array twice as long as the keys that are left.  Keys that
fall alone on a bit are settled there; the others go on to the next level.  The
value of a key is the rank of its bit over all levels, which is one stored count
and the bits of one word, so a lookup takes the same time whatever the size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from sourceloom.llm.words import mix

GAMMA = 2.0
_STEP = 0x9E3779B97F4A7C15


class Level(NamedTuple):
    words: np.ndarray  # 64 bits each
    ranks: np.ndarray  # set bits before each word, those of earlier levels included


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * _STEP % (1 << 64))) % np.uint64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def build_levels(keys: np.ndarray) -> list[Level]:
    """The levels of distinct uint64 keys."""
    levels: list[Level] = []
    total = 0
    while len(keys):
        size = max(64, int(GAMMA * len(keys) + 63) // 64 * 64)
        at = _position(keys, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        words = np.packbits(alone, bitorder="little").view(np.uint64)
        count = np.bitwise_count(words).astype(np.int64)
        levels.append(Level(words, (total + np.cumsum(count) - count).astype(np.uint32)))
        total += int(count.sum())
        keys = keys[~alone[at]]
    return levels


def slots(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for keys that end on no bit (any slot for other strangers)."""
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    for number, level in enumerate(levels):
        if not len(left):
            break
        at = _position(keys[left], number, 64 * len(level.words))
        word, bit = level.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
        hit = (word & bit) != 0
        rank = level.ranks[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1)))
        out[left[hit]] = rank[hit]
        left = left[~hit]
    return out

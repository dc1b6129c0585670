"""Induced sorting of the suffixes of a shard, in bulk steps.

Suffixes are of type S (smaller than the next one) or L.  Those of type S whose
left neighbour is of type L are sorted directly; all others follow from them:
passing through the suffixes in order, the left neighbour of each goes to the
queue of its first byte.  Order within a queue is the order of arrival, so each
queue is first in, first out, and a whole queue is taken at a time.

Only ``depth`` leading bytes count: the directly sorted suffixes are compared on
so many bytes, and no order beyond them is promised.  So no recursion is needed.
"""

from __future__ import annotations

import numpy as np


class PackedText:
    """The next bytes of every position as one 64-bit number, in the order of the bytes.

    Bytes are coded by their rank among those that occur, so a number holds 8
    bytes or more; past the end of the text it goes on with the smallest code.
    """

    def __init__(self, text: np.ndarray) -> None:
        present = np.flatnonzero(np.bincount(text, minlength=256))
        bits = max(1, int(len(present) - 1).bit_length())
        code = np.zeros(256, np.uint64)
        code[present] = np.arange(len(present))
        self.bits, self.width = bits, 64 // bits
        block, have = code[text], 1
        self.words = np.zeros(len(text) + 1, np.uint64)
        done, rest = 0, self.width
        while rest:  # blocks of 1, 2, 4, ... bytes, put together
            if rest & 1:
                self.words[: len(text)] = (self.words[: len(text)] << np.uint64(bits * have)) | self._later(block, done)
                done += have
            rest >>= 1
            block, have = (block << np.uint64(bits * have)) | self._later(block, have), 2 * have

    @staticmethod
    def _later(block: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(block)
        out[: max(0, len(block) - by)] = block[by:]
        return out

    def at(self, positions: np.ndarray, length: int) -> list[np.ndarray]:
        """Numbers that cover ``length`` bytes from each position at least."""
        return [self.words[np.minimum(positions + k, len(self.words) - 1)] for k in range(0, length, self.width)]


def sorted_by(columns: list[np.ndarray]) -> np.ndarray:
    """Indices in the order of the columns, the first one first.

    One sort by the first column; only groups of equal numbers in it whose other
    columns differ are sorted again.
    """
    order = np.argsort(columns[0], kind="stable")
    if len(columns) == 1 or len(order) < 2:
        return order
    first = columns[0][order]
    tie = first[1:] == first[:-1]
    differ = np.zeros(len(tie), bool)
    for column in columns[1:]:
        own = column[order]
        differ |= own[1:] != own[:-1]
    group = np.concatenate([[0], np.cumsum(~tie)])
    mixed = np.zeros(group[-1] + 1, bool)
    mixed[group[1:][tie & differ]] = True
    again = np.flatnonzero(mixed[group])
    rows = order[again]
    order[again] = rows[np.lexsort([c[rows] for c in columns[::-1]])]
    return order


def types(text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S; the last one is S, and smaller than any that it begins."""
    n = len(text)
    place = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(place[::-1])[::-1]  # where the run of equal bytes ends
    rising = np.append(text[:-1] < text[1:], False)
    return np.append(rising[following], True)


def _deal(queues: list[list[np.ndarray]], found: np.ndarray, first: np.ndarray) -> None:
    """Append positions to the queues of their bytes, in order."""
    order = np.argsort(first, kind="stable")
    found, first = found[order], first[order]
    at = np.flatnonzero(np.diff(first, prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(first)], strict=True):
        queues[first[a]].append(found[a:b])


def suffix_order(text: np.ndarray, depth: int, packed: PackedText | None = None) -> np.ndarray:
    """Positions of ``text`` (bytes, ending in its smallest) in the order of their first ``depth`` bytes."""
    n = len(text)
    is_s = types(text)
    star = np.flatnonzero(is_s[1:-1] & ~is_s[:-2]) + 1
    star = star[sorted_by((packed or PackedText(text)).at(star, depth))]
    byte = text.astype(np.int16)
    none = np.zeros(0, np.int64)

    def induce(seeds: list[np.ndarray], order: range, want_s: bool) -> list[np.ndarray]:
        """All suffixes of one type by their first byte, each list in the order of the pass."""
        queues: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []
        if not want_s and n > 1:  # the last suffix comes before all others
            queues[byte[n - 2]].append(np.array([n - 2]))
        for c in order:
            done: list[np.ndarray] = []
            after = [seeds[c]] if len(seeds[c]) else []
            while queues[c] or after:
                # suffixes of this type that begin with c come before the seeds of c in either pass
                batch = queues[c] or after
                if queues[c]:
                    queues[c] = []
                    taken = np.concatenate(batch)
                    done.append(taken)
                else:
                    after = []
                    taken = batch[0]
                left = taken[taken > 0] - 1
                left = left[is_s[left] == want_s]
                if len(left):
                    _deal(queues, left, byte[left])
            out.append(np.concatenate(done) if done else none)
        return out

    cut = np.searchsorted(byte[star], np.arange(257))
    seeds = [star[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    # the L suffixes, upwards; within a byte they come before the S suffixes
    low = induce(seeds, range(256), want_s=False)
    # the S suffixes, downwards; within a byte they come after the L suffixes
    high = induce([x[::-1] for x in low], range(255, -1, -1), want_s=True)[::-1]
    last = np.array([n - 1])
    parts = []
    for c in range(256):
        if c == byte[n - 1]:
            parts.append(last)
        parts += [low[c], high[c][::-1]]
    return np.concatenate(parts)


def equal_groups(text: np.ndarray, order: np.ndarray, length: int, packed: PackedText | None = None) -> np.ndarray:
    """For positions in suffix order, the number of the group of equal ``length``-byte strings."""
    packed = packed or PackedText(text)
    new = np.zeros(len(order), bool)
    new[:1] = True
    columns = packed.at(order, length)
    if over := len(columns) * packed.width - length:
        columns[-1] = columns[-1] >> np.uint64(packed.bits * over)
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new) - 1

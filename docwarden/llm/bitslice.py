"""Hamming comparison of wide signatures: bit-sliced in large blocks, listed in short runs.

In a block, signatures are stored vertically: plane b holds bit b of 64
signatures in each machine word, so one XOR compares a bit of 64 pairs.  The
differences are added up in vertical counters (counter bit c of 64 pairs in one
word) by carry-save adders, and a word is dropped as soon as all of its pairs
exceed the radius.  Runs of few rows would leave most of the 64 lanes empty, so
their pairs are listed and compared a signature word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: planes that are added between two tests of which words are still needed
STRIDE = 16
#: pairs of short runs that are listed at once
LISTED = 1 << 17


def planes_of(signatures: np.ndarray) -> np.ndarray:
    """Transposes (n, words) signatures to (64 * words, ceil(n / 64)) planes; lanes beyond n are 0."""
    n, words = signatures.shape
    bits = np.unpackbits(np.ascontiguousarray(signatures).view(np.uint8).reshape(n, 8 * words), axis=1, bitorder="little")
    lanes = np.zeros((64 * words, -(-n // 64) * 64), dtype=np.uint8)
    lanes[:, :n] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


class Counters:
    """Vertical counters over an array of words."""

    def __init__(self, shape: tuple[int, ...], most: int):
        self.bits = [np.zeros(shape, dtype=np.uint64) for _ in range(most.bit_length())]

    def _add(self, value: np.ndarray, level: int) -> None:
        for i in range(level, len(self.bits)):
            carry = self.bits[i] & value
            self.bits[i] ^= value
            value = carry

    def add_pairs(self, planes: list[np.ndarray]) -> None:
        """Adds planes two at a time: a carry-save adder takes both and the ones counter."""
        for a, b in zip(planes[::2], planes[1::2]):
            self.bits[0], carry = _carry_save(self.bits[0], a, b)
            self._add(carry, 1)
        if len(planes) % 2:
            self._add(planes[-1], 0)

    def at_most(self, limit: int) -> np.ndarray:
        """Mask of the lanes whose count is at most the limit."""
        less = np.zeros_like(self.bits[0])
        equal = np.full_like(self.bits[0], _ONES)
        for i in range(len(self.bits) - 1, -1, -1):
            if limit >> i & 1:
                less |= equal & ~self.bits[i]
                equal &= self.bits[i]
            else:
                equal &= ~self.bits[i]
        return less | equal

    def keep(self, chosen: np.ndarray) -> None:
        self.bits = [x[chosen] for x in self.bits]


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (word, lane) of the set bits."""
    flat = np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little"))
    return flat >> 6, flat & 63


def block_parts(left: np.ndarray, right: np.ndarray, radius: int, skipped: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some pairs (i of left, j of right) within the radius at a time; ``skipped`` holds for each row of left the first row of right that is left out and the one behind the last."""
    if not len(left) or not len(right):
        return
    width = 64 * left.shape[1]
    planes = planes_of(right)
    m, columns = len(right), planes.shape[1]
    tail = np.full(columns, _ONES)
    if m % 64:
        tail[-1] = np.uint64((1 << (m % 64)) - 1)
    step = max(1, (1 << 16) // columns)
    for at in range(0, len(left), step):
        queries = left[at : at + step]
        count = len(queries)
        first, last = (x[at : at + step] for x in skipped)
        row, column = np.repeat(np.arange(count), columns), np.tile(np.arange(columns), count)
        needed = (column * 64 < first[row]) | (np.minimum(column * 64 + 64, m) > last[row])
        row, column = row[needed], column[needed]
        if not len(row):
            continue
        bits = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(count, -1), axis=1, bitorder="little")
        flip = np.where(bits, _ONES, np.uint64(0))
        alive = tail[column]
        counters = Counters(row.shape, width)
        for b in range(0, width, STRIDE):
            counters.add_pairs([planes[x][column] ^ flip[row, x] for x in range(b, b + STRIDE)])
            if b + STRIDE > radius:
                alive = alive & counters.at_most(radius)
                keep = np.flatnonzero(alive)
                if len(keep) < len(row):
                    row, column, alive = row[keep], column[keep], alive[keep]
                    counters.keep(keep)
                if not len(row):
                    break
        if len(row):
            word, lane = _lanes(alive)
            i, j = row[word], column[word] * 64 + lane
            keep = (j < first[i]) | (j >= last[i])
            yield i[keep] + at, j[keep]


def block_pairs(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i of left, j of right) within the radius; with ``same`` only i < j."""
    none = np.zeros(len(left), np.int64)
    found = [(none[:0], none[:0]), *block_parts(left, right, radius, (none, np.arange(1, len(left) + 1) if same else none))]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def near_in_runs(signatures: np.ndarray, size_left: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius among neighbours of the same short run.

    Rows are sorted by run; ``size_left[i]`` counts the later rows of row i's
    run.  All pairs of some runs are listed, and those that exceed the radius
    leave the list after each word.
    """
    n, width = signatures.shape
    words = [np.ascontiguousarray(signatures[:, w]) for w in range(width)]
    upto = np.concatenate(([0], np.cumsum(size_left)))
    none = np.zeros(0, np.int64)
    found_i, found_j = [none], [none]
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(upto, upto[lo] + LISTED, side="right")) - 1))
        i = np.repeat(np.arange(lo, hi), size_left[lo:hi])
        # the pairs of row r are numbered from upto[r]
        j = i + 1 + np.arange(upto[lo], upto[hi]) - upto[i]
        differing = np.zeros(len(i), dtype=np.uint16)
        for word in words:
            differing += np.bitwise_count(word[i] ^ word[j])
            keep = np.flatnonzero(differing <= radius)
            if len(keep) < len(i):
                i, j, differing = i[keep], j[keep], differing[keep]
        found_i.append(i)
        found_j.append(j)
        lo = hi
    return np.concatenate(found_i), np.concatenate(found_j)

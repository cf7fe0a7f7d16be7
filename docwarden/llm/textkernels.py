"""Vectorised text kernels shared by the corpus operators.

The kernels work on whole Arrow string columns: bytes are classified, hashed
and reduced with numpy, so no Python object is made per word.  A column is cut
into runs of documents of about ``CHUNK_BYTES`` bytes first, so that the
temporary arrays stay small whatever the batch size; a longer document forms
a run of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def _geometric(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


_POWERS = [_geometric(_MULT, 1 << 12), _geometric(_INV, 1 << 12)]


def geometric_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the multiplier and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS[:] = _geometric(_MULT, size), _geometric(_INV, size)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

# A classification gives each byte the kind of word that it belongs to, 0 where it separates words.
_WHITE = [9, 10, 11, 12, 13, 32]

#: exact words: all but ASCII white space, in every language alike
EXACT = np.ones(256, dtype=np.uint8)
EXACT[_WHITE] = 0

#: folded words: letters and digits; every other ASCII character separates
ALNUM = np.ones(256, dtype=np.uint8)
ALNUM[:128] = [chr(i).isalnum() for i in range(128)]

#: letters and digits are words, and so are runs of signs
WORDS_AND_SIGNS = np.where(EXACT == 0, 0, np.where(ALNUM == 1, 1, 2)).astype(np.uint8)

_FOLD = np.arange(256)
_FOLD[65:91] += 32
FOLDED_CODES = _BYTE_CODES[_FOLD]
EXACT_CODES = _BYTE_CODES


class Words:
    """Words of a run of documents: byte spans, hashes and document bounds.

    ``doc_start`` has one entry more than there are documents; the words of
    document d are ``doc_start[d]:doc_start[d + 1]``.  Without codes there are
    no hashes.
    """

    __slots__ = ("data", "start", "end", "hash", "doc_start", "doc_byte")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray, codes: np.ndarray | None):
        self.data, self.doc_byte = data, bounds
        kind = kinds[data]
        inside = kind > 0
        first, last = inside.copy(), inside.copy()
        changes = kind[1:] != kind[:-1]
        first[1:] &= changes
        last[:-1] &= changes
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc_start = np.searchsorted(self.start, bounds)
        if codes is None:
            self.hash = np.zeros(0, dtype=np.uint64)
        elif len(self.start):
            up, down = geometric_pair(len(data))
            weighted = codes[data] * up
            weighted[~inside] = 0
            self.hash = mix(np.add.reduceat(weighted, self.start) * down[self.start])
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def doc_of(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.doc_start) - 1), np.diff(self.doc_start))


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 byte bounds of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), bounds - bounds[0]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def runs(column: pa.Array | pa.ChunkedArray, kinds: np.ndarray = EXACT, codes: np.ndarray | None = EXACT_CODES) -> Iterator[tuple[int, int, Words]]:
    """Yields (first row, last row + 1, Words) over a string column."""
    data, bounds = string_parts(column)
    n, row = len(bounds) - 1, 0
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop, Words(data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row], kinds, codes)
        row = stop


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive values, by binary doubling; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    done, power, block = 0, h, 1
    while True:
        if k & block:
            out = out * np.uint64(pow(_MULT, block, 1 << 64)) + power[done : done + n]
            done += block
        block <<= 1
        if block > k:
            return mix(out)
        half = block >> 1
        power = power[:-half] * np.uint64(pow(_MULT, half, 1 << 64)) + power[half:]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w consecutive values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


_LANES = np.zeros(256, dtype=np.uint64)
for _b in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)


def bit_votes(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many features of each group have each of the 64 bits set.

    ``bounds`` are the n + 1 group limits.  Eight counters of eight bits share
    one word; groups are summed in slices of at most 255 features, so that no
    counter can overflow, and the slices are widened before they are added.
    """
    sizes = np.diff(bounds)
    n = len(sizes)
    votes = np.zeros((n, 64), dtype=np.int64)
    if not len(features):
        return votes
    parts = (sizes + 254) // 255
    owner = np.repeat(np.arange(n), parts)
    part_start = np.cumsum(parts) - parts
    begin = bounds[:-1][owner] + 255 * (np.arange(len(owner)) - part_start[owner])
    octets = features.view(np.uint8).reshape(-1, 8)
    busy = np.flatnonzero(parts)
    for byte in range(8):
        sums = np.add.reduceat(_LANES[octets[:, byte]], begin)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes[busy, 8 * byte : 8 * byte + 8] = np.add.reduceat(lanes, part_start[busy], axis=0)
    return votes

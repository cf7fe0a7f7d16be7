"""Packing documents into fixed windows by the sum-of-squares rule.

N(g) counts the open bins with residual gap g.  Each piece goes where the sum
of N(g)**2 becomes smallest: into a bin that it fills, into a larger gap, or
into a new bin.  Keeping the profile of gaps flat keeps a gap of nearly every
size open, so later pieces find exact fits and little is wasted.

Scale: only ids and lengths are shuffled.  The rule is sequential, so documents
are dealt by hash to shards of about ``shard_words`` words each, whose number
grows with the input, and of ``SHARD_ROWS`` documents at most on average; each
shard packs its own bins.  Documents that repeat both id and length are counted
before the shuffle and dealt one by one, so an id that is everywhere is spread.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.base import cut, doc_columns

CAPACITY = 2048
SHARD_WORDS = 1 << 25
SHARD_ROWS = 1 << 19


class SumOfSquares:
    """Open bins of one shard; :meth:`place` gives the bin and the offset of a piece."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)
        self.waiting: dict[int, deque[int]] = {}
        self.bins = 0

    def choose(self, size: int) -> int:
        """Gap of the bin to use, or capacity + 1 for a new bin; of ties an exact fit, then the smallest gap, then a new bin."""
        n, full = self.open, self.capacity
        if size == full:
            return full + 1
        best, least = full + 1, 2 * int(n[full - size]) + 1
        larger = n[size + 1 :]
        if larger.any():
            change = np.where(larger > 0, 2 * (n[1 : full - size + 1] - larger) + 2, np.iinfo(np.int64).max)
            at = int(np.argmin(change))
            if change[at] <= least:
                best, least = size + 1 + at, int(change[at])
        if n[size] and 1 - 2 * int(n[size]) <= least:
            best = size
        return best

    def place(self, size: int) -> tuple[int, int]:
        gap = self.choose(size)
        if gap > self.capacity:
            gap, number = self.capacity, self.bins
            self.bins += 1
        else:
            number = self.waiting[gap].popleft()
            self.open[gap] -= 1
        if rest := gap - size:
            self.open[rest] += 1
            self.waiting.setdefault(rest, deque()).append(number)
        return number, self.capacity - gap


def _packer(capacity: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        order = np.lexsort((rows["n_words"].to_numpy(), rows["doc_id"].to_numpy(), rows["turn"].to_numpy()))
        ids, words = rows["doc_id"].to_numpy()[order], rows["n_words"].to_numpy()[order]
        pieces = -(-words // capacity)
        total = int(pieces.sum())
        start = (np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        size = np.minimum(capacity, np.repeat(words, pieces) - start)
        bins, offset = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64)
        state = SumOfSquares(capacity)
        for i in range(total):
            bins[i], offset[i] = state.place(int(size[i]))
        return pd.DataFrame({"bin_id": shard << 40 | bins, "bin_offset": offset, "doc_id": np.repeat(ids, pieces), "start_word": start, "n_words": size})

    return pack


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+"))


def pack_lengths(lengths: DataFrame, *, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs a table (doc_id long, n_words long); see :func:`pack_documents`."""
    counted = cut(lengths.filter("doc_id is not null and n_words > 0").groupBy("doc_id", "n_words").agg(F.count("*").alias("rows")))
    words, rows = counted.agg(F.sum(F.col("n_words") * F.col("rows")), F.sum("rows")).first()
    shards = max(1, -(-(words or 0) // shard_words), -(-(rows or 0) // shard_rows))
    each = counted.select("doc_id", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    dealt = each.withColumn("turn", F.xxhash64("doc_id", "n_words", "copy")).withColumn("shard", F.pmod(F.col("turn"), F.lit(shards))).drop("copy")
    return dealt.groupBy("shard").applyInPandas(_packer(capacity), "bin_id long, bin_offset long, doc_id long, start_word long, n_words long")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (bin_id, bin_offset, doc_id, start_word, n_words): which words of each document go where in which bin.

    Lengths count words (runs of anything but ASCII white space); to pack by
    other units give their counts to :func:`pack_lengths`.  A document of more
    than ``capacity`` words is cut into full bins and a rest; every word of
    every document is in exactly one bin.  Documents come in the order of a hash
    of their id and length, each within its shard; the number of shards follows
    from all words and documents (``shard_words``, ``shard_rows``), so a
    document's bin depends on what else is packed.  Defined cases: null ids, null
    texts and texts without a word have no rows; rows that repeat an id are packed
    one by one, as often as they occur; an empty table gives no rows; other
    columns are not looked at.
    """
    known = doc_columns(docs).select("doc_id", word_count(F.col("text")).cast("long").alias("n_words"))
    return pack_lengths(known, capacity=capacity, shard_words=shard_words, shard_rows=shard_rows)

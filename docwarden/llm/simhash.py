"""Near duplicates: wide SimHash signatures compared in buckets.

Each document gets a 256-bit SimHash of its set of folded words.  Documents of
one signature are collapsed to the one of least id first, so thousands of exact
copies cost one comparison row.  The distinct signatures meet in buckets of
sampled signature bits (band keys), and within a bucket every row is compared
with every other one by :mod:`docwarden.llm.bitslice`: pairs of ordinary buckets
are listed, those of crowded ones compared bit-sliced, but for rows that are
joined already by a row that is near to both.  Only the edges of a
spanning forest leave a bucket, and connected components make the groups.

Scale: the shuffles carry signatures (about 50 bytes a document and band),
never texts.  Buckets of more than ``block_rows`` rows are cut into blocks whose
pairs are separate tasks, so no task holds a whole bucket; all pairs are still
compared.  The bits of a band follow from the number of distinct signatures, so
that a bucket of unlike ones has about ``BUCKET_ROWS`` whatever the corpus's size,
and the number of bands follows from the bits, so that a pair at the radius
itself meets with probability ``RECALL`` (nearer ones more often: 0.999 at 25).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from docwarden.llm.base import cut, doc_columns, lean, version_of, whole_rows
from docwarden.llm.bitslice import block_parts, near_in_runs
from docwarden.llm.components import components
from docwarden.llm.textkernels import ALNUM, FOLDED_CODES, bit_votes, mix, runs

WIDTH = 4
RADIUS = 40
RECALL = 0.97
BUCKET_ROWS = 64
LEAST_BAND_BITS = 16
BLOCK_ROWS = 8192
#: as many large buckets (a few bytes each) are broadcast; more are joined by a shuffle
MOST_BROADCAST = 100_000
_SHORT_RUN = 512
#: rows of a crowded bucket that are compared with all others first
_STARS = 16
_SEEDS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_WORDS = [f"s{i}" for i in range(WIDTH)]
_SIGNATURE = ", ".join(f"{w} long" for w in _WORDS)


def signatures_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(n, 4) SimHash words of a string column, over each text's set of folded words."""
    parts = [np.zeros((0, WIDTH), dtype=np.uint64)]
    for _, _, words in runs(column, ALNUM, FOLDED_CODES):
        n = len(words.doc_start) - 1
        out = np.zeros((n, WIDTH), dtype=np.uint64)
        for at in range(0, n, 1 << 15):
            upto = min(n, at + (1 << 15))
            lo, hi = words.doc_start[at], words.doc_start[upto]
            owner = np.repeat(np.arange(upto - at, dtype=np.uint64), np.diff(words.doc_start[at : upto + 1]))
            key = np.sort((owner << np.uint64(48)) | (words.hash[lo:hi] >> np.uint64(16)))
            key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
            bounds = np.searchsorted(key, np.arange(upto - at + 1, dtype=np.uint64) << np.uint64(48))
            size = np.diff(bounds)[:, None]
            for w, seed in enumerate(_SEEDS):
                votes = bit_votes(mix((key & np.uint64((1 << 48) - 1)) ^ seed), bounds)
                out[at:upto, w] = np.packbits(votes * 2 > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
        parts.append(out)
    return np.concatenate(parts)


def bands_for(rows: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """Number of bands and bits of each for a number of distinct signatures."""
    bits = max(LEAST_BAND_BITS, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))
    meet = (1 - radius / (64 * WIDTH)) ** bits
    return math.ceil(math.log(1 - recall) / math.log1p(-meet)), bits


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = signatures_of(batch["text"]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], *(pa.array(words[:, i].copy()) for i in range(WIDTH))], names=["doc_id", "version", *_WORDS])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text) and signature of every row that has an id and a text."""
    known = doc_columns(docs).filter("doc_id is not null and text is not null")
    return known.select("doc_id", version_of(F.col("text")).alias("version"), "text").mapInArrow(lean(_signature_batches), f"doc_id long, version long, {_SIGNATURE}")


def _band_places(bands: int, band_bits: int) -> np.ndarray:
    """Which signature bits make each band's key: permutations laid end to end."""
    rng = np.random.default_rng(20240229)
    order = np.concatenate([rng.permutation(64 * WIDTH) for _ in range(-(-bands * band_bits // (64 * WIDTH)))])
    return order[: bands * band_bits].reshape(bands, band_bits)


def _bander(bands: int, band_bits: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _band_places(bands, band_bits)
        weights = 1 << np.arange(band_bits, dtype=np.int64)
        for batch in batches:
            words = np.stack([batch[w].to_numpy(zero_copy_only=False) for w in _WORDS], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
            for band in range(bands):
                key = bits[:, places[band]].astype(np.int64) @ weights + (band << band_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["bucket", *batch.schema.names])

    return spread


def _merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each row's least of its part) after the pairs (x, y) have joined parts."""
    apart = label[x] != label[y]
    x, y = x[apart], y[apart]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that join what the pairs (a, b) join: each id with the least of its part."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _merged(np.arange(len(ids)), flat[: len(a)], flat[len(a) :])
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _stars(words: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the rows after some of them, none near an earlier one, have been joined with all that are near."""
    label = np.arange(len(words))
    lone = np.ones(len(words), dtype=bool)
    for k in range(_STARS):
        left = np.flatnonzero(lone)
        if len(left) < 2:
            break
        near = np.bitwise_count(words ^ words[left[k * len(left) // _STARS]]).sum(axis=1) <= radius
        lone[near] = False
        roots = np.unique(label[near])
        label[np.isin(label, roots)] = roots[0]
    return label


def linked(words: np.ndarray, radius: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that join what the pairs within the radius join.

    With ``first``, only pairs of one of the first so many rows and a later one
    count (others may be joined, too, if they are near).  No pair is compared
    whose rows a star has joined.
    """
    label = _stars(words, radius)
    cut_at = 0 if first is None else first
    left = np.argsort(label if first is None else label[:first], kind="stable")
    right = cut_at + np.argsort(label[cut_at:], kind="stable")
    begin, end = (np.searchsorted(label[right], label[left], side=s) for s in ("left", "right"))
    if first is None:
        # earlier rows have been compared with this one
        begin = np.zeros_like(begin)
    for i, j in block_parts(words[left], words[right], radius, (begin, end)):
        label = _merged(label, left[i], right[j])
    other = np.flatnonzero(label != np.arange(len(words)))
    return other, label[other]


def _comparer(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by (bucket, first, second, side); a task's part may end inside a batch."""
        held: list[tuple] = []
        keys: np.ndarray | None = None

        def flush(key, ids, words, side) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            size_of = np.repeat(sizes, sizes)
            cross = key[:, 1] != key[:, 2]
            short = (size_of > 1) & (size_of <= _SHORT_RUN) & ~cross
            found = []
            if short.any():
                left = (np.repeat(starts + sizes, sizes) - 1 - np.arange(len(key)))[short]
                i, j = near_in_runs(words[short], left, radius)
                found.append((ids[short][i], ids[short][j]))
            for at in np.flatnonzero(cross[starts] | (sizes > _SHORT_RUN)).tolist():
                part = slice(starts[at], starts[at] + sizes[at])
                i, j = linked(words[part], radius, int(np.sum(side[part] == 0)) if cross[starts[at]] else None)
                found.append((ids[part][i], ids[part][j]))
            if found:
                a, b = _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch[name].to_numpy(zero_copy_only=False)
            key = np.stack([column("bucket"), column("first"), column("second")], axis=1)
            row = (key, column("node"), np.stack([column(w) for w in _WORDS], axis=1).view(np.uint64), column("side"))
            # what belongs to the last key of this batch may go on in the next one
            ends = np.flatnonzero(np.any(key != key[-1], axis=1))
            split = int(ends[-1]) + 1 if len(ends) else 0
            if split or (held and not np.array_equal(keys, key[0])):
                head = [x[:split] for x in row]
                yield from flush(*(np.concatenate([h[c] for h in held] + [head[c]]) for c in range(4)))
                held = [tuple(x[split:] for x in row)]
            else:
                held.append(row)
            keys = key[-1]
        if held:
            yield from flush(*(np.concatenate([h[c] for h in held]) for c in range(4)))

    return compare


def near_edges(sigs: DataFrame, *, radius: int = RADIUS, recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that join all signatures (node, s0 .. s3) within the radius that share a bucket."""
    cols = ["node", *_WORDS]
    bands, band_bits = bands_for(sigs.count(), radius, recall)
    spread = sigs.select(*cols).mapInArrow(lean(_bander(bands, band_bits)), f"bucket long, node long, {_SIGNATURE}")
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)
    large = cut(sizes.select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    number = large.count()
    if number <= MOST_BROADCAST:
        # few or no buckets have several blocks, so the rows needn't move to learn of theirs
        sized = spread.join(F.broadcast(large), "bucket", "left") if number else spread.withColumn("blocks", F.lit(None).cast("int"))
    else:
        sized = spread.join(large, "bucket", "left")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a bucket of one block meets itself; with more, block x meets every block y once, as the pair (least, greatest)
    parts = F.when(F.coalesce("blocks", F.lit(1)) <= 1, F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda y: F.struct(F.least(mine, y).alias("first"), F.greatest(mine, y).alias("second"), F.when(mine <= y, 0).otherwise(1).alias("side")),
        )
    )
    placed = sized.select(*cols, "bucket", F.explode(parts).alias("p")).select("bucket", "p.first", "p.second", "p.side", *cols)
    ordered = placed.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second", "side", "node")
    return ordered.mapInArrow(lean(_comparer(radius)), "a long, b long")


def _groups(docs: DataFrame, **limits: float) -> DataFrame:
    """Rows (doc_id, version, kept) of the distinct texts of every id; kept: (doc_id, version) of the first of the group."""
    sigs = cut(signatures(docs).distinct())
    nodes = sigs.groupBy(*_WORDS).agg(F.min(F.struct("doc_id", "version")).alias("first"), F.count("*").alias("texts"))
    # numbered behind a checkpoint, so that every reader sees the same numbers
    nodes = cut(nodes).withColumn("node", F.monotonically_increasing_id())
    linked = components(near_edges(nodes.select("node", *_WORDS), **limits)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.sum("texts").alias("texts")).filter("texts > 1")
    # what is in no group isn't looked up again
    placed = rooted.join(least.select("root", "kept"), "root").select(*_WORDS, "kept")
    return sigs.join(placed, _WORDS).select("doc_id", "version", "kept")


def near_duplicates(docs: DataFrame, **limits: float) -> DataFrame:
    """One row (doc_id, kept_id, copies) for each document that repeats another.

    ``kept_id`` is the least doc_id of the group and has no row of its own;
    ``copies`` counts the group's distinct ids.  Two documents are in one group
    if a chain of pairs that met joins them: of pairs within ``radius`` of 256
    bits all of equal signature meet, and others if they share a bucket, which
    they do with probability ``recall`` at the radius and more often below.
    Defined cases: a null id or null text is in no group; texts without a word
    (empty, only punctuation) are copies of each other; rows that repeat both id
    and text are one document; an id with unlike texts may be in several groups,
    of which the one of least kept_id counts; ties go to the least id; an empty
    table gives no rows; columns besides doc_id and text are not looked at.
    Texts are read whole.
    """
    group = _groups(docs, **limits).groupBy("doc_id").agg(F.min("kept.doc_id").alias("kept_id"))
    sizes = group.groupBy("kept_id").agg(F.count("*").alias("copies"))
    return group.filter("doc_id <> kept_id").join(sizes, "kept_id").select("doc_id", "kept_id", "copies")


def drop_near_duplicates(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows without those that repeat another; all columns stay.

    Of each group of :func:`near_duplicates` the row of least (doc_id, hash of
    the text) stays.  Defined cases: rows with a null id or null text all stay;
    of rows that repeat both id and text one stays; unlike texts of one id are
    judged each by its own; other columns may have any names; an empty table
    stays empty.
    """
    lost = _groups(docs, **limits).filter("kept.doc_id <> doc_id or kept.version <> version").select("doc_id", "version")
    text, doc = docs["text"].cast("string"), docs["doc_id"].cast("long")
    # rows that are never compared are spread by all they hold
    apart = F.when(doc.isNull() | text.isNull(), F.xxhash64(F.struct(*(docs[f"`{c}`"] for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType))))).otherwise(0)
    rows = whole_rows(docs, doc.alias("doc_id"), version_of(text).alias("version"), apart.alias("apart"), (doc.isNull() | text.isNull()).alias("free"))
    left = rows.join(lost.withColumn("apart", F.lit(0).cast("long")), ["doc_id", "version", "apart"], "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id", "version", "apart").orderBy("free"))
    return left.withColumn("place", place).filter("place = 1 or free").select("row.*")

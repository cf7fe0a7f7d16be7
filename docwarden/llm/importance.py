"""Quality selection by importance resampling.

Two generative models of hashed word and word-pair counts are made: one of the
target (documents labelled good) and one of the raw corpus (all documents).  A
document's log importance weight is the sum over its n-grams of the log ratio of
the two.  Adding Gumbel noise to the weights and taking the k greatest draws k
documents without replacement in proportion to their weights.

Scale: the counts of both models are partial sums of ``BUCKETS`` cells a task, so
every document takes part.  The k-th greatest key is found exactly by narrowing
histograms of the keys; neither texts nor keys are sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.base import cut, doc_columns
from docwarden.llm.textkernels import EXACT_CODES, WORDS_AND_SIGNS, gram_hashes, mix, runs

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
_EXACT_BELOW = 20_000


def _ngram_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bucket of each n-gram, document of each n-gram) over runs of documents."""
    for first, stop, words in runs(column, WORDS_AND_SIGNS, EXACT_CODES):
        doc = words.doc_of()
        pairs = gram_hashes(words.hash, 2)
        inner = np.flatnonzero(doc[: len(pairs)] == doc[1:]) if len(pairs) else np.zeros(0, np.int64)
        bucket = np.concatenate((words.hash, pairs[inner])) & np.uint64(BUCKETS - 1)
        yield first, stop, bucket.astype(np.int64), np.concatenate((doc, doc[inner]))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, _, bucket, _ in _ngram_buckets(batch["text"]):
            counts += np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])


def _frequencies(texts: DataFrame) -> np.ndarray:
    """Log frequencies of the hashed n-grams of all texts; every bucket has one count more."""
    rows = texts.select("text").mapInArrow(_counter, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.ones(BUCKETS)
    counts[rows["bucket"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=float)
    return np.log(counts / counts.sum())


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise as a function of the id, the same in every run and attempt."""
    bits = mix(ids.astype(np.int64).view(np.uint64) ^ mix(np.array([seed], dtype=np.uint64)))
    uniform = (np.right_shift(bits, np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return -np.log(-np.log(uniform))


def _scorer(ratio: np.ndarray, seed: int):
    packed = ratio.astype(np.float64).tobytes()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(packed)
        for batch in batches:
            total = np.zeros(len(batch))
            for first, stop, bucket, doc in _ngram_buckets(batch["text"]):
                total[first:stop] = np.bincount(doc, weights=ratio[bucket], minlength=stop - first)
            total = np.round(total, 6)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total), pa.array(np.round(total + gumbel(batch["doc_id"].to_numpy(), seed), 9))], names=["doc_id", "log_weight", "gumbel_key"])

    return score


def greatest(scores: DataFrame, k: int, key: str = "gumbel_key", tie: str = "doc_id") -> DataFrame:
    """The k rows of greatest key, of ties those of least ``tie``; exact, by narrowing histograms."""
    if k <= 0:
        return scores.limit(0)
    low, high, count = scores.agg(F.min(key), F.max(key), F.count("*")).first()
    if count <= k:
        return scores
    above, inside = 0, count
    while inside > _EXACT_BELOW and high > low:
        width = (high - low) / 1024
        if low + width == low or high - width == high:
            break
        cell = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(1023)).alias("cell")
        found = scores.filter(F.col(key).between(low, high)).groupBy(cell).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                low, high, inside = r["low"], r["high"], r["n"]
                break
            above += r["n"]
    # what is left between low and high is ranked; all above is taken
    middle = scores.filter(F.col(key).between(low, high))
    place = F.row_number().over(Window.orderBy(F.desc(key), tie))
    return scores.filter(F.col(key) > high).unionByName(middle.withColumn("__place", place).filter(F.col("__place") <= k - above).drop("__place"))


def importance_sample(docs: DataFrame, labels: DataFrame, *, fraction: float | None = None, target_rows: int = TARGET_ROWS, seed: int = 17) -> DataFrame:
    """Rows (doc_id, log_weight, gumbel_key) of the documents drawn.

    The target model is made of at most ``target_rows`` documents labelled with
    quality 1 (those of least hash), the raw model of all documents.  The number
    drawn is ``fraction`` of the documents, by default the share of quality 1 in
    the labels, rounded to even halves.  Defined cases: null ids and null texts
    are not drawn nor counted; empty texts have weight 0; rows that repeat an id
    are drawn one by one with the same noise; without labels of quality 1 all
    weights are 0, and the default fraction is 1 without any labels; ties go to
    the least id; an empty table gives no rows; other columns are not looked at.
    """
    known = doc_columns(docs).filter("doc_id is not null and text is not null")
    rated = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    good, all_rated = rated.agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.count("*")).first()
    good = good or 0
    if fraction is None:
        fraction = good / all_rated if all_rated else 1.0
    raw = _frequencies(known)
    ratio = np.zeros(BUCKETS)
    if good:
        share = min(1.0, 20 * target_rows / good)
        near = rated.filter("quality = 1").select("doc_id").distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)))
        wanted = near.filter(F.col("h") <= int(share * 1_000_000_007)).orderBy("h", "doc_id").limit(target_rows).select("doc_id")
        # the sample is bounded by target_rows, so it may be broadcast at any size of the corpus
        ratio = _frequencies(known.join(F.broadcast(wanted), "doc_id")) - raw
    scores = cut(known.mapInArrow(_scorer(ratio, seed), "doc_id long, log_weight double, gumbel_key double"))
    return greatest(scores, round(fraction * scores.count()))

"""Byte-level BPE over a corpus, by one shuffle of distinct words.

Encoding goes in three steps.  A scan splits texts into pre-tokens and gives
each chunk of documents a dictionary: the text becomes positions in it, which
are written as a table in the shared folder, and the dictionary's words go, in
sorted blocks by a hash of the word, to the tasks that encode.  All blocks of a
word's hash meet in one task, so each distinct word of the corpus is merged once.
The ids come back to the chunks, where the positions are replaced by them.

Decoding joins ids with the table of token bytes, which has the vocabulary's
fixed size.

Scale: no row is made per token.  Shuffled are the chunk dictionaries (a few
bytes per distinct word and chunk) alone; the compressed positions stay in the
written table, from which the task that has a chunk's ids reads them.  Buckets of
words follow the size of the input and are dealt to tasks by ranges; a task holds
the words of one bucket at a time.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm.base import doc_columns, give_back, new_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 16 << 20
#: a bucket for so many bytes of input, so that the distinct words of one fit in a task, and no more than so many
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 4096
_ZSTD = pa.Codec("zstd", compression_level=3)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes with their ranks, one base64 word and number per line; all single bytes must be there."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks single bytes")
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged, the leftmost first, until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n <= 40:
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            least, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (least is None or rank < least):
                    least, at = rank, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # long words: a heap of pairs over a linked list, where pairs that have changed are skipped
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if gone[i] or middle >= n or end[middle] != stop:
            continue
        gone[middle] = 1
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        last = before[i]
        if last >= 0 and (r := ranks.get(word[last:stop])) is not None:
            heapq.heappush(heap, (r, last, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def _pack(data: np.ndarray | bytes) -> bytes:
    raw = data if isinstance(data, bytes) else data.tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def _unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _ZSTD.decompress(data[8:], size, asbytes=True) if size else b""


#: numbers are packed and unpacked so many at a time, since the steps between need forty bytes each
_SLICE = 1 << 19


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the least first, a high bit where more follow."""
    parts = []
    for at in range(0, len(values), _SLICE):
        part = values[at : at + _SLICE]
        size = np.ones(len(part), dtype=np.int64)
        for limit in (1 << 7, 1 << 14, 1 << 21, 1 << 28):
            size += part >= limit
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), dtype=np.uint8)
        for k in range(5):
            has = np.flatnonzero(size > k)
            out[start[has] + k] = (part[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
        parts.append(out.tobytes())
    return b"".join(parts)


def _from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.empty(int(np.count_nonzero(raw < 128)), dtype=np.int32)
    at = done = 0
    while at < len(raw):
        part = raw[at : at + _SLICE]
        ends = np.flatnonzero(part < 128)
        part = part[: ends[-1] + 1]
        start = np.concatenate(([0], ends[:-1] + 1))
        place = np.arange(len(part)) - np.repeat(start, ends + 1 - start)
        out[done : done + len(ends)] = np.add.reduceat((part & 127).astype(np.int64) << 7 * place, start)
        at, done = at + len(part), done + len(ends)
    return out


_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.large_binary()), ("more", pa.large_binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
_CHUNK_TYPES = "chunk long, bucket int, payload binary, more binary, doc_ids array<long>, counts array<int>"


def _chunker(buckets: int, chunk_chars: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(PATTERN).findall
        number = TaskContext.get().partitionId() << 24
        places: dict[str, int] = {}
        ids: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        chars = 0

        def finish() -> pa.RecordBatch:
            codes = np.concatenate([*parts, np.zeros(0, np.int32)])
            parts.clear()
            often = np.argsort(-np.bincount(codes, minlength=len(places)), kind="stable")
            rank = np.empty(len(places), dtype=np.int32)
            rank[often] = np.arange(len(places))
            blocks: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
            for word, place in places.items():
                raw = word.encode("utf-8")
                blocks[zlib.crc32(raw) % buckets].append((raw, int(rank[place])))
            order: list[int] = []
            rows = []
            for bucket, block in enumerate(blocks):
                if block:
                    block.sort()
                    order += [r for _, r in block]
                    lengths = np.array([len(w) for w, _ in block], dtype=np.int64)
                    rows.append((number, bucket, _pack(b"".join(w for w, _ in block)), _pack(_varints(lengths)), None, None))
            rows.append((number, -1, _pack(_varints(rank[codes])), _pack(_varints(np.array(order, dtype=np.int64))), list(ids), list(counts)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CHUNK_SCHEMA.types)], schema=_CHUNK_SCHEMA)

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids.append(doc.as_py())
                text = text.as_py()
                if text is None:
                    counts.append(-1)
                else:
                    codes = [places.setdefault(word, len(places)) for word in find(text)]
                    parts.append(np.array(codes, dtype=np.int32))
                    counts.append(len(codes))
                    chars += len(text)
                if chars >= chunk_chars:
                    yield finish()
                    number, chars = number + 1, 0
                    places.clear(), ids.clear(), counts.clear(), parts.clear()
        if ids:
            yield finish()
        give_back()

    return chunks


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows one by one, so that only one row's payload is a Python object at a time."""
    columns = [batch[n] for n in names]
    for i in range(len(batch)):
        yield tuple(c[i].as_py() for c in columns)


def _word_encoder(ranks_of):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of words, sorted by bucket, become blocks of ids."""
        ranks = ranks_of.value
        known: dict[bytes, list[int]] = {}
        at = None
        for batch in batches:
            for chunk, bucket, payload, more in _rows(batch, "chunk", "bucket", "payload", "more"):
                if bucket != at:
                    known, at = {}, bucket
                raw, ends = _unpack(payload), np.cumsum(_from_varints(_unpack(more)), dtype=np.int64).tolist()
                flat: list[int] = []
                sizes = []
                start = 0
                for end in ends:
                    word = raw[start:end]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = merge_word(word, ranks)
                    flat += found
                    sizes.append(len(found))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([chunk], [bucket], [_pack(_varints(np.array(flat, dtype=np.int64)))], [_pack(_varints(np.array(sizes, dtype=np.int64)))], [None], [None]), _CHUNK_SCHEMA.types)], schema=_CHUNK_SCHEMA)
        known.clear()
        give_back()

    return encode


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i]:start[i] + size[i]] for each i, end to end."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)]


def _positions(path: str, chunk: int) -> tuple:
    """Positions, order of words, ids and counts of a chunk, from the file of the table that holds it."""
    system, place = fs.FileSystem.from_uri(path)
    row = pq.read_table(place, filesystem=system, columns=["payload", "more", "doc_ids", "counts"], filters=[("chunk", "=", chunk), ("bucket", "=", -1)])
    return _from_varints(_unpack(row["payload"][0].as_py())), _from_varints(_unpack(row["more"][0].as_py())), row["doc_ids"].combine_chunks().flatten(), row["counts"].combine_chunks().flatten().to_numpy()


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (chunk, bucket): the file that has each chunk's positions, then its blocks of ids in order."""
    at: tuple[str, int] | None = None
    blocks: list[tuple[np.ndarray, np.ndarray]] = []

    def finish() -> Iterator[pa.RecordBatch]:
        codes, order, doc_ids, counts = _positions(*at)
        flat = np.concatenate([b[0] for b in blocks] or [np.zeros(0, np.int32)])
        sizes = np.concatenate([b[1] for b in blocks] or [np.zeros(0, np.int32)]).astype(np.int64)
        blocks.clear()
        starts = np.cumsum(sizes) - sizes
        start, size = np.empty_like(starts), np.empty_like(sizes)
        start[order], size[order] = starts, sizes
        words = np.maximum(counts, 0).astype(np.int64)
        ends = np.cumsum(words)
        # as many documents at a time as have about a million words
        edges = [0]
        while edges[-1] < len(counts):
            begun = ends[edges[-1]] - words[edges[-1]]
            edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, begun + (1 << 20), side="right"))))
        for first, stop in zip(edges[:-1], edges[1:]):
            base = ends[first] - words[first]
            mine = codes[base : ends[stop - 1]]
            ids = _gather(flat, start[mine], size[mine])
            before = np.concatenate(([0], np.cumsum(size[mine])))
            bounds = before[np.concatenate(([0], ends[first:stop] - base))]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=pa.array(counts[first:stop] < 0))
            yield pa.RecordBatch.from_arrays([doc_ids[first:stop], lists], names=["doc_id", "token_ids"])

    for batch in batches:
        for chunk, bucket, path, payload, more in _rows(batch, "chunk", "bucket", "path", "payload", "more"):
            if bucket < 0:
                if at:
                    yield from finish()
                at = path, chunk
            else:
                blocks.append((_from_varints(_unpack(payload)), _from_varints(_unpack(more))))
    if at:
        yield from finish()


def _id_blocks(docs: DataFrame, vocabulary: str, chunk_chars: int) -> DataFrame:
    """What :func:`_assemble` takes."""
    spark: SparkSession = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the planner's estimate needs no scan; it only decides how finely the words are dealt
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(tasks, min(MOST_BUCKETS, size // BUCKET_BYTES))
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    path = new_folder(spark, "bpe-chunks")
    doc_columns(docs).mapInArrow(_chunker(buckets, chunk_chars), _CHUNK_TYPES).write.parquet(path, compression="none")
    chunks = spark.read.schema(_CHUNK_TYPES).parquet(path)
    words = chunks.filter("bucket >= 0").select("chunk", "bucket", "payload", "more", "doc_ids", "counts").repartitionByRange(tasks, "bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(_word_encoder(ranks), _CHUNK_TYPES).select("chunk", "bucket", F.lit(None).cast("string").alias("path"), "payload", "more")
    nothing = F.lit(None).cast("binary")
    places = chunks.filter("bucket < 0").select("chunk", "bucket", F.col("_metadata.file_path").alias("path"), nothing.alias("payload"), nothing.alias("more"))
    back = places.unionByName(ids).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return back


def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows (doc_id, token_ids), one for each document row, in no order.

    The special tokens' strings are ordinary text.  Defined cases: a null text
    has null ids, an empty one none; a null id is kept; repeated rows are each
    encoded; texts and words of any length are encoded whole; an empty table
    gives no rows; other columns are not looked at.
    """
    return _id_blocks(docs, vocabulary, chunk_chars).mapInArrow(_assemble, "doc_id long, token_ids array<int>")


def _decoder(ranks_of):
    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of.value
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        size = np.array([len(t) for t in table])
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        for batch in batches:
            lists = batch["token_ids"]
            ids = lists.flatten().to_numpy()
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
            text = _gather(flat, start[ids], size[ids])
            ends = np.concatenate(([0], np.cumsum(size[ids])))[bounds]
            nulls = lists.is_null().to_numpy(zero_copy_only=False)
            raw = [None if nulls[i] else text[ends[i] : ends[i + 1]].tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, pa.array(raw, pa.binary())], names=["doc_id", "token_ids", "bytes"])

    return join_bytes


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``bytes``, the joined token bytes, to rows (doc_id, token_ids); null ids give null, no ids give none.

    Defined cases: ids outside the vocabulary, and null ones within a list, are
    an error; a null doc_id is kept; repeated rows are each decoded; an empty table
    gives no rows; other columns are not looked at.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    return encoded.select("doc_id", "token_ids").mapInArrow(_decoder(ranks), "doc_id long, token_ids array<int>, bytes binary")


def encode_and_check(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_tokens, token_ids, text_md5); the digest is of the text as decoded from the ids."""
    blocks = _id_blocks(docs, vocabulary, CHUNK_CHARS)
    join_bytes = _decoder(blocks.sparkSession.sparkContext.broadcast(read_ranks(vocabulary)))
    # both steps in one worker, so that ids don't go through the JVM between them
    decoded = blocks.mapInArrow(lambda batches: join_bytes(_assemble(batches)), "doc_id long, token_ids array<int>, bytes binary")
    return decoded.select("doc_id", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "token_ids", F.md5("bytes").alias("text_md5"))

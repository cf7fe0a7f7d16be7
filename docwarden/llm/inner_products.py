"""Exact top-k inner products of query vectors with all others.

Vectors are rotated by the right singular vectors of the whole table, which
moves most of the inner product to the first coordinates, and stored in blocks
by descending length; vectors of about one length are dealt to blocks by the
signs of their leading coordinates.  Each task takes blocks of queries through
the item blocks in that order.  A block is skipped for the queries that can't
gain from it: an inner product is at most the query's length times the block's
greatest length, and at most the query's product with the block's centre plus
its length times the block's radius.  For a pair, the partial sum over the leading
coordinates plus the product of the lengths of the rests (Cauchy-Schwarz) bounds
the inner product; pairs whose bound is below the query's k-th best are dropped
before the rest is summed.

Scale: the Gram matrix (dimension squared) is all that the driver gets.  Blocks
are raw bytes in the shared folder with one table of their places, bounds and
centres, which a task reads once; a block is read by its byte range, and only if
a query of the task may gain from it.  A task holds one block of queries and one
of items, whatever the table's size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.base import cut, new_folder

BLOCK_ROWS = 4096
#: so many blocks of items of about one length are dealt by direction
BAND_BLOCKS = 16
#: the leading coordinates hold this share of the squared lengths
LEADING_SHARE = 0.9
DECIMALS = 6
_SLACK = 2 * 10.0**-DECIMALS
_PLACES = "file string, at long, n long, greatest double, radius double, centre binary"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if len(batch):
            x = _matrix(batch["v"])
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])


def _rotater(rotation: np.ndarray):
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                y = _matrix(batch["v"]) @ rotation
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.sqrt((y * y).sum(1))), pa.array([r.tobytes() for r in y], pa.binary())], names=["id", "length", "y"])

    return rotate


def _by_direction(matrix: np.ndarray, parts: int) -> np.ndarray:
    """Order of rows in which each of so many equal parts has like directions: halves by one leading coordinate after the other."""
    order = np.arange(len(matrix))
    groups, axis = [order], 0
    while len(groups) < parts and axis < matrix.shape[1]:
        halves = []
        for g in groups:
            by = g[np.argsort(matrix[g, axis], kind="stable")]
            halves += [by[: len(by) // 2], by[len(by) // 2 :]]
        groups, axis = halves, axis + 1
    return np.concatenate(groups)


def _blocker(folder: str, block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by descending length; a task appends its blocks to a file of its own and gives their places."""
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}"
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, at = 0, 0
        places: list[tuple] = []

        def finish(out) -> None:
            nonlocal at
            ids, matrix = (np.concatenate(x) for x in zip(*held))
            order = _by_direction(matrix, -(-len(ids) // block_rows))
            for lo in range(0, len(ids), block_rows):
                mine = order[lo : lo + block_rows]
                y = np.ascontiguousarray(matrix[mine])
                centre = y.mean(0)
                greatest, radius = np.sqrt((y * y).sum(1).max()), np.sqrt(((y - centre) ** 2).sum(1).max())
                raw = ids[mine].tobytes() + y.tobytes()
                out.write(raw)
                places.append((name, at, len(mine), float(greatest), float(radius), centre.tobytes()))
                at += len(raw)

        out = None
        for batch in batches:
            if not len(batch):
                continue
            out = out or system.open_output_stream(name)
            held.append((batch["id"].to_numpy(), np.frombuffer(b"".join(batch["y"].to_pylist())).reshape(len(batch), -1)))
            rows += len(batch)
            if rows >= BAND_BLOCKS * block_rows:
                finish(out)
                held, rows = [], 0
        if held:
            finish(out)
        if out:
            out.close()
        if places:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places), (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))], names=[c.split()[0] for c in _PLACES.split(", ")])

    return pack


class Blocks:
    """The item blocks of a folder, longest vectors first."""

    def __init__(self, uri: str):
        self.system, root = fs.FileSystem.from_uri(uri)
        table = pq.read_table(f"{root}/places", filesystem=self.system).sort_by([("greatest", "descending"), ("file", "ascending"), ("at", "ascending")])
        self.file, self.at, self.n = (table[c].to_pylist() for c in ("file", "at", "n"))
        self.greatest, self.radius = table["greatest"].to_numpy(), table["radius"].to_numpy()
        self.centre = np.frombuffer(b"".join(table["centre"].to_pylist())).reshape(len(self.file), -1)
        self.open: tuple[str, pa.NativeFile] | None = None

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and matrix of a block."""
        if self.open is None or self.open[0] != self.file[block]:
            if self.open:
                self.open[1].close()
            self.open = self.file[block], self.system.open_input_file(self.file[block])
        n, d = self.n[block], self.centre.shape[1]
        raw = self.open[1].read_at(8 * n * (d + 1), self.at[block])
        return np.frombuffer(raw, dtype=np.int64, count=n), np.frombuffer(raw, offset=8 * n).reshape(n, d)


class Best:
    """The k best items of each query of a block, by rounded score and then least id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        """Adds pairs (query number, item id, score)."""
        keep = np.flatnonzero(score >= self.score[query, -1])
        query, item, score = query[keep], item[keep], score[keep]
        touched = np.unique(query)
        if not len(touched):
            return
        q = np.concatenate((np.repeat(touched, self.k), query))
        i = np.concatenate((self.id[touched].ravel(), item))
        s = np.concatenate((self.score[touched].ravel(), score))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, touched)
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.score[touched] = s[take].reshape(-1, self.k)
        self.id[touched] = i[take].reshape(-1, self.k)


def search(blocks: Blocks, ids: np.ndarray, queries: np.ndarray, k: int, lead: int) -> tuple[Best, dict[str, int]]:
    """The k best items of each query, and how many pairs there were, had a partial sum and had the whole sum."""
    best = Best(len(ids), k)
    length = np.sqrt((queries * queries).sum(1))
    rest = np.sqrt((queries[:, lead:] ** 2).sum(1))
    seen = {"pairs": len(ids) * int(sum(blocks.n)), "partial": 0, "whole": 0}
    for block, (greatest, radius) in enumerate(zip(blocks.greatest, blocks.radius)):
        floor = best.floor() - _SLACK
        if not np.any(length * greatest >= floor):
            break
        open_ = np.flatnonzero(np.minimum(length * greatest, queries @ blocks.centre[block] + length * radius) >= floor)
        if not len(open_):
            continue
        item_ids, items = blocks.read(block)
        item_rest = np.sqrt((items[:, lead:] ** 2).sum(1))
        for at in range(0, len(open_), 512):
            mine = open_[at : at + 512]
            partial = queries[mine, :lead] @ items[:, :lead].T
            bound = partial + rest[mine, None] * item_rest[None, :]
            q, i = np.nonzero(bound >= best.floor()[mine, None] - _SLACK)
            seen["partial"] += partial.size
            if len(q) * 8 > partial.size:
                seen["whole"] += partial.size
                score = (partial + queries[mine, lead:] @ items[:, lead:].T)[q, i]
            else:
                seen["whole"] += len(q)
                score = partial[q, i] + np.einsum("ij,ij->i", queries[mine[q], lead:], items[i, lead:])
            other = ids[mine[q]] != item_ids[i]
            best.add(mine[q[other]], item_ids[i[other]], np.round(score[other], DECIMALS))
    return best, seen


def _searcher(path: str, k: int, lead: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(path)
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                part = batch.slice(at, block_rows)
                ids = part["id"].to_numpy()
                queries = np.frombuffer(b"".join(part["y"].to_pylist())).reshape(len(ids), -1)
                best, _ = search(blocks, ids, queries, k, lead)
                query, place = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[query]), pa.array(place + 1), pa.array(best.id[query, place]), pa.array(best.score[query, place] + 0.0)],
                    names=["query_id", "rank", "vec_id", "score"],
                )

    return run


def top_inner_products(vectors: DataFrame, k: int = 10, *, every: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every query the k other vectors of greatest inner product.

    The queries are the vectors whose id ``every`` divides, by default all; they
    are compared with all vectors.  Scores are rounded to 6 decimals; ties go to
    the least id.  Defined cases: null ids, null or empty vectors and vectors with
    a null or a value that is not finite are left out, and so are vectors of
    another length than the most frequent one (of ties the longer one); of rows
    that repeat an id the least vector counts; a vector is no neighbour of itself;
    with fewer than k others all are given; an empty table gives no rows; other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    given = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    sound = given.filter("id is not null and size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usual = sound.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    types = "query_id long, rank long, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], types)
    one = cut(sound.filter(F.size("v") == usual["n"]).groupBy("id").agg(F.min("v").alias("v")))
    d = usual["n"]
    gram = np.zeros((d, d))
    for r in one.select("v").mapInArrow(_gram, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r["i"], r["j"]] = r["s"]
    energy, rotation = np.linalg.eigh(gram)
    energy, rotation = np.maximum(energy[::-1], 0), np.ascontiguousarray(rotation[:, ::-1])
    lead = int(np.searchsorted(np.cumsum(energy), LEADING_SHARE * energy.sum())) + 1
    rotate, rotated = _rotater(rotation), "id long, length double, y binary"
    path = new_folder(spark, "inner-product-blocks")
    one.mapInArrow(rotate, rotated).orderBy(F.desc("length"), "id").mapInArrow(_blocker(f"{path}/blocks", block_rows), _PLACES).write.parquet(f"{path}/places")
    asked = one.filter(F.col("id") % every == 0)
    # enough tasks for all cores, and at most a block of queries in each
    tasks = max(spark.sparkContext.defaultParallelism * 2, -(-asked.count() // block_rows))
    return asked.repartition(tasks, "id").mapInArrow(rotate, rotated).mapInArrow(_searcher(path, k, min(lead, d), block_rows), types)

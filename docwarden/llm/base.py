"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see, as the session names it in spark.checkpoint.dir.

    Only a local session (one machine, as in tests) that names none gets a
    temporary folder of its own; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docwarden-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage with files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder for a written table in the shared folder.

    What an operator writes there is read when its result is, so it stays until
    :func:`remove_folder` is called or the shared folder is cleared.
    """
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Returns freed memory to the system; an idle worker would keep it for as long as the executor lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over Arrow batches that gives its memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def replaced(column: pa.Array, texts: dict[int, str]) -> pa.Array:
    """The column with some of its rows replaced."""
    if not texts:
        return column
    rows = sorted(texts)
    mask = np.zeros(len(column), dtype=bool)
    mask[rows] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([texts[i] for i in rows], column.type))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, so that no other name can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def whole_rows(docs: DataFrame, *extra: Column) -> DataFrame:
    """Every row as one struct column ``row`` beside the extra columns, so that no name of the table can clash with theirs."""
    return docs.select(F.struct("*").alias("row"), *extra)


def unwrapped(batch: pa.RecordBatch) -> tuple[list[str], list[pa.Array]]:
    """Names and arrays of the struct column ``row``."""
    rows = batch["row"]
    return [rows.type.field(i).name for i in range(rows.type.num_fields)], rows.flatten()


def version_of(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text)


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """Replaces the text and, where the table has one, the count of its characters."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

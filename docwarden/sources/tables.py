"""Any table with texts as documents; the engine's operators don't care where a text comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, per_task: int = 8000) -> DataFrame:
    """Rows over tasks of about ``per_task`` rows, for work that takes long on each; files of small rows come as few tasks.

    Counting reads the footers of the files only.  Rows that fit one task stay where they are.
    """
    tasks = -(-rows.count() // per_task)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def as_documents(rows: DataFrame, path: Column, text: Column, skill: Column | None = None) -> DataFrame:
    """path, skill and raw_text; the skill is the path if none is given."""
    return rows.select(path.cast("string").alias("path"), (skill if skill is not None else path).cast("string").alias("skill"), text.cast("string").alias("raw_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(read(spark, sf_dir, "documents"), F.concat(F.lit("doc-"), F.col("doc_id")), F.col("text"), F.col("source"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(read(spark, sf_dir, "pages"), F.concat(F.lit("page-"), F.col("page_id")), F.col("html"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(read(spark, sf_dir, "conversations"), F.concat_ws("-", F.lit("turn"), "conv_id", "turn"), F.col("text"), F.concat(F.lit("conv-"), F.col("conv_id")))

"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docwarden.llm import packing, repeats, secrets, simhash, toxicity
from docwarden.llm.base import new_folder, remove_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; it is fitted on the labelled ones of those given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut from the texts."""
    return repeats.cut_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which words of each document go where in which bin."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: The learned lexicon, SimHash and the packing rule can't be expressed in SQL; tests/llm/test_pipeline.py holds each stage
#: against a brute-force version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's table goes to the shared folder, and goes from it once the next one is written.

    Defined cases: the first four stages keep rows with a null id or text as they
    are, whatever other columns there are, and the last one packs none of them; of
    rows that repeat both id and text one stays, unlike texts of one id are each
    judged by their own; empty texts are copies of each other; an empty table gives
    no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

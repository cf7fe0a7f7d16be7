"""Scans of a stream of documents: an extension, since a scan of one document needs no state.

The plan of :func:`docwarden.plans.scan.local_candidates` has no shuffle, so it
is the same for a stream; counts of findings use event time and a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docwarden.config import Config
from docwarden.plans.scan import scan
from docwarden.rulepack import Rule


def stream_findings(docs: DataFrame, rules: Sequence[Rule], config: Config | None = None, *, front_matter: bool = False) -> DataFrame:
    """Findings of a stream (path, skill, raw_text); rules that compare documents don't run."""
    return scan(docs, rules, config, front_matter=front_matter)


def write_findings(findings: DataFrame, folder: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Appends findings as Parquet; the checkpoint makes each document count once, also after a loss."""
    writer = findings.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, *, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and tumbling window of event time; windows close once the watermark has passed them."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n")

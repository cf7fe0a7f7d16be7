"""A scan of a workspace: documents, rules and policy to findings and totals, with a cache between scans."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.config import Config, ConfigError
from docwarden.model import FINDING
from docwarden.operators import ACROSS, LOCAL
from docwarden.plans import across, score
from docwarden.plans.parse import name_documents, parse
from docwarden.plans.scan import local_candidates, to_findings
from docwarden.rulepack import REMOTE_RULES, Rule, Selection, fingerprint, select
from docwarden.session import cut
from docwarden.sources import files

#: warnings of a kind that are shown one by one; all are counted
MOST_WARNINGS = 1000


@dataclass
class ScanResult:
    """Findings stay a DataFrame; what is here as numbers is as large as the policy, not as the input."""

    findings: DataFrame
    warnings: list[str]
    scanned_files: int
    selection: Selection
    config: Config
    aggregate_score: int
    aggregate_severity: str
    counts: dict[str, int]
    total: int
    seconds: float
    cache_hits: int = 0
    cache_misses: int = 0
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)


def scan_fingerprint(rules: Sequence[Rule], config: Config, selection: Selection) -> str:
    """Digest of all that findings of an unchanged file depend on."""
    return hashlib.sha256("|".join((fingerprint(rules), config.fingerprint(), ",".join(selection.executed), "3")).encode()).hexdigest()[:32]


def parsed_documents(docs: DataFrame) -> DataFrame:
    """Documents of a tree with names."""
    return name_documents(parse(docs))


class Cache:
    """Findings of earlier scans: one Parquet table for each fingerprint, replaced as a whole by each scan.

    The folder must be one that all executors see.  A document hits if its path,
    digest, time, name and the server file that it uses are what they were.
    """

    KEYS = ("path", "sha256", "mtime_ns", "skill", "server_digest")

    def __init__(self, spark: SparkSession, folder: str, mark: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/scan_fp={mark}"

    def _hadoop(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def newest(self) -> str | None:
        """The latest version that was written to its end."""
        system, path = self._hadoop()
        if not system.exists(path):
            return None
        done = [s.getPath() for s in system.listStatus(path) if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(map(str, (p.toString() for p in done)), default=None)

    def read(self) -> DataFrame:
        at = self.newest()
        kinds = f"path string, sha256 string, mtime_ns long, skill string, server_digest string, findings array<struct<{_as_struct(FINDING)}>>"
        return self.spark.read.schema(kinds).parquet(at) if at else self.spark.createDataFrame([], kinds)

    def write(self, entries: DataFrame) -> None:
        old = self.newest()
        entries.write.parquet(f"{self.folder}/{time.time_ns():020d}-{uuid.uuid4().hex}")
        if old:
            self._hadoop()[0].delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)


def _as_struct(columns: str) -> str:
    """Columns of a table as the fields of a struct."""
    return ",".join(":".join(part.split(" ", 1)) for part in columns.split(", "))


def _told(rows: DataFrame, what: str) -> list[str]:
    """Warnings of a table with a column ``text``: the first ones, and how many more there are."""
    first = [r["text"] for r in rows.limit(MOST_WARNINGS + 1).collect()]
    if len(first) <= MOST_WARNINGS:
        return first
    return [*first[:MOST_WARNINGS], f"{rows.count() - MOST_WARNINGS} more {what}"]


def scan_workspace(
    spark: SparkSession, root: str | Path, rules: Sequence[Rule], config: Config | None = None, *,
    disable: Sequence[str] = (), only: Sequence[str] = (), cache: str | None = None,
) -> ScanResult:
    """Scans the tree below a root.  Documents that can't be read are counted, and warned of."""
    began = time.monotonic()
    config = config or Config()
    if not Path(root).is_dir():
        raise ConfigError(f"{root}: no such folder")
    selection = select(rules, config, disable=disable, only=only)
    chosen = [r for r in rules if r.public_id in selection.executed]
    documents = cut(parsed_documents(files.documents(spark, root, globs=config.skill_globs, max_file_mb=config.max_file_mb)))
    warnings = list(selection.warnings)
    warnings += _told(documents.filter("parse_error is not null").select("path", F.concat("path", F.lit(": "), "parse_error").alias("text")).orderBy("path"), "documents that can't be read")
    shared = documents.filter("name_collides").groupBy(F.regexp_replace("skill", "-[0-9a-f]{8}$", "").alias("name")).count()
    warnings += _told(shared.select("name", F.concat(F.col("count").cast("string"), F.lit(" documents are named "), "name", F.lit("; a digest of the path tells them apart")).alias("text")).orderBy("name"), "shared names")
    readable = documents.filter("parse_error is null")
    server_files = files.server_files(spark, root)
    nearest = across.nearest_above(readable, server_files).join(server_files.select(F.col("path").alias("above"), F.sha2("text", 256).alias("server_digest")), "above").select("path", "server_digest")
    keyed = cut(readable.join(nearest, "path", "left"))
    known = None
    if cache:
        store = Cache(spark, cache, scan_fingerprint(rules, config, selection))
        before = store.read()
        same = [keyed[k].eqNullSafe(before[k]) for k in Cache.KEYS]
        on = same[0]
        for s in same[1:]:
            on = on & s
        known = keyed.join(before, on, "inner").select(*[keyed[k] for k in Cache.KEYS], before["findings"])
        known = cut(known)
        keyed = keyed.join(known.select(F.col("path").alias("__hit")), F.col("path") == F.col("__hit"), "left_anti")
    found = [local_candidates(keyed, [r for r in chosen if r.strategy in LOCAL], config)]
    for rule in chosen:
        if rule.strategy == "typosquat_check":
            hits = across.similar_names(readable, rule, config)
        elif rule.strategy == "bundled_scripts_check":
            hits = across.bundled_scripts(readable, files.package_files(spark, root), rule, config)
        else:
            continue
        found.append(hits)
    if set(REMOTE_RULES) & set(selection.executed):
        servers = cut(across.servers_of(keyed, server_files))
        warnings += _told(servers.filter("error is not null").select("file", F.concat("file", F.lit(": "), "error").alias("text")).distinct().orderBy("file"), "server files that can't be read")
        found.append(across.remote_servers(servers, config, selection.executed))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    findings = cut(to_findings(candidates, config))
    hits = misses = 0
    if cache:
        # what depends on other files is looked for anew; all else of an unchanged document is as it was
        fixed = findings.filter(~F.col("rule_id").isin(*[r.public_id for r in rules if r.strategy in ACROSS]))
        loose = findings.filter(F.col("rule_id").isin(*[r.public_id for r in rules if r.strategy in ACROSS]))
        per_name = fixed.groupBy(F.col("skill").alias("__skill")).agg(F.collect_list(F.struct(*fixed.columns)).alias("findings"))
        entries = keyed.join(per_name, F.col("skill") == F.col("__skill"), "left").select(*Cache.KEYS, F.coalesce("findings", F.array().cast(f"array<struct<{_as_struct(FINDING)}>>")).alias("findings"))
        hits, misses = known.count(), keyed.count()
        store.write(known.unionByName(entries))
        # the next scan replaces the table, which mustn't take the result with it
        findings = cut(store.read().select(F.explode("findings").alias("f")).select("f.*").unionByName(loose))
    total = score.workspace(findings, config).first()
    return ScanResult(
        findings=findings, warnings=warnings, scanned_files=documents.count(), selection=selection, config=config, aggregate_score=total["aggregate_score"],
        aggregate_severity=total["aggregate_severity"], counts={k: total[k] for k in ("high", "medium", "low")}, total=total["total_findings"],
        seconds=time.monotonic() - began, cache_hits=hits, cache_misses=misses,
        overrides={k: {n: v for n, v in (("max_severity", o.max_severity), ("min_severity", o.min_severity)) if v} for k, o in sorted(config.overrides.items()) if k in selection.executed and (o.min_severity or o.max_severity)},
    )

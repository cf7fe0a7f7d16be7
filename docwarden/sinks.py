"""Where findings go: per-skill JSON, CSV, SARIF, JSON lines, plain text.

``write_*_tables`` write with Spark, in parallel and committed as a whole, for
results of any size.  The other writers make the single files that tools expect;
they stream the rows to the driver one partition at a time.
"""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path
from typing import IO, Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from docwarden.config import Config
from docwarden.plans import score

SCHEMA_VERSION = "1.0.0"
CSV_COLUMNS = tuple("id skill rule_id severity classification score confidence path line title description recommendation".split())
_LEVELS = {"high": "error", "medium": "warning", "low": "note"}
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/cos02/schemas/sarif-schema-2.1.0.json"


def flat(findings: DataFrame) -> DataFrame:
    """The columns of the CSV file."""
    return findings.withColumns({"path": F.col("evidence.path"), "line": F.col("evidence.line")}).select(*CSV_COLUMNS)


def write_csv_tables(findings: DataFrame, folder: str) -> None:
    flat(findings).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(folder)


def write_json_tables(findings: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each skill, whatever their number."""
    findings.withColumn("skill_name", F.col("skill")).write.mode("overwrite").partitionBy("skill").json(folder)


def write_summary_tables(findings: DataFrame, config: Config, folder: str) -> None:
    score.summaries(findings, config).write.mode("overwrite").json(folder)


def _whole(path: Path, write: Callable[[IO[str]], None]) -> Path:
    """Writes a file beside its place, then moves it there."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=".new-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            write(out)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def finding_dict(row: Row) -> dict[str, Any]:
    """A finding as it is written; a policy's change is left out if there was none."""
    out = row.asDict(recursive=True)
    if out.get("severity_override") is None:
        out.pop("severity_override", None)
    return out


def _ordered(findings: DataFrame) -> Iterator[Row]:
    return findings.orderBy(F.desc("score"), "id").toLocalIterator()


def write_skill_reports(shown: DataFrame, findings: DataFrame, config: Config, out: Path, about: dict[str, Any] | None = None) -> int:
    """<skill>/findings.json (by id) and <skill>/summary.json; summaries are of all findings.  Gives the number of skills."""
    shown_by = {r["skill"]: r["n"] for r in shown.groupBy("skill").agg(F.count("*").alias("n")).toLocalIterator()}
    rows = shown.groupBy("skill").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in shown.columns if c != "id"]))).alias("rows"))
    for row in rows.toLocalIterator():
        _whole(out / row["skill"] / "findings.json", lambda f, r=row: f.write(json.dumps([finding_dict(x) for x in r["rows"]], indent=2, sort_keys=True) + "\n"))
    n = 0
    for row in score.summaries(findings, config).toLocalIterator():
        summary = {"schema_version": SCHEMA_VERSION} | row.asDict(recursive=True) | {"shown_finding_count": shown_by.get(row["skill"], 0)} | (about or {})
        _whole(out / row["skill"] / "summary.json", lambda f, s=summary: f.write(json.dumps(s, indent=2, sort_keys=True) + "\n"))
        if row["skill"] not in shown_by:
            _whole(out / row["skill"] / "findings.json", lambda f: f.write("[]\n"))
        n += 1
    return n


def write_csv(findings: DataFrame, path: Path) -> Path:
    def write(out: IO[str]) -> None:
        to = csv.writer(out, lineterminator="\n")
        to.writerow(CSV_COLUMNS)
        for row in _ordered(findings.withColumns({"path": F.col("evidence.path"), "line": F.col("evidence.line")})):
            to.writerow(["" if row[c] is None else row[c] for c in CSV_COLUMNS])

    return _whole(path, write)


def sarif_result(row: Row) -> dict[str, Any]:
    place: dict[str, Any] = {"artifactLocation": {"uri": row["evidence"]["path"]}}
    if row["evidence"]["line"] is not None:
        place["region"] = {"startLine": row["evidence"]["line"]}
    about = {k: row[k] for k in ("score", "confidence", "skill", "recommendation", "classification")}
    if row["severity_override"] is not None:
        about["severity_override"] = row["severity_override"].asDict()
    return {
        "ruleId": row["rule_id"], "level": _LEVELS[row["severity"]], "message": {"text": row["description"]},
        "locations": [{"physicalLocation": place}], "partialFingerprints": {"findingId": row["id"]}, "properties": about,
    }


def sarif_parts(findings: DataFrame, about: dict[str, Any] | None = None) -> Iterator[str]:
    """A SARIF 2.1.0 document in pieces, one finding at a time; a rule has the title of its gravest finding."""
    rules = findings.groupBy("rule_id").agg(F.min_by("title", F.struct(F.negate("score"), "id")).alias("title"), F.count("*").alias("n")).orderBy("rule_id").collect()
    run = {
        "tool": {"driver": {"name": "docwarden", "version": SCHEMA_VERSION, "rules": [{"id": r["rule_id"], "shortDescription": {"text": r["title"]}} for r in rules]}},
        "results": [],
        "properties": {"ruleDistribution": {r["rule_id"]: r["n"] for r in rules}} | (about or {}),
    }
    before, after = json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2).split('"results": []', 1)
    yield before + '"results": ['
    for i, row in enumerate(_ordered(findings)):
        yield ("," if i else "") + "\n        " + json.dumps(sarif_result(row), indent=2).replace("\n", "\n        ")
    yield "]" + after + "\n"


def sarif(findings: DataFrame, about: dict[str, Any] | None = None) -> dict[str, Any]:
    """The whole document at once, for few findings."""
    return json.loads("".join(sarif_parts(findings, about)))


def write_sarif(findings: DataFrame, path: Path, about: dict[str, Any] | None = None) -> Path:
    return _whole(path, lambda out: out.writelines(sarif_parts(findings, about)))


def json_lines(shown: DataFrame, warnings: list[str], summary: dict[str, Any] | None) -> Iterator[str]:
    """Findings, warnings, then the summary, each in an envelope."""

    def envelope(kind: str, data: dict[str, Any]) -> str:
        return json.dumps({"type": kind, "version": SCHEMA_VERSION, "timestamp": datetime.now(UTC).isoformat(), "data": data}, sort_keys=True) + "\n"

    for row in _ordered(shown):
        yield envelope("finding", finding_dict(row))
    for text in warnings:
        yield envelope("warning", {"message": text})
    if summary is not None:
        yield envelope("summary", summary)


def write_json_lines(lines: Iterator[str], path: Path, *, append: bool = False) -> Path:
    if append:
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as out:
            out.writelines(lines)
        return path
    return _whole(path, lambda out: out.writelines(lines))


_RED, _YELLOW, _CYAN, _GREEN, _PLAIN = "\033[31m", "\033[33m", "\033[36m", "\033[32m", "\033[0m"
_SEVERITY_COLOURS = {"high": _RED, "medium": _YELLOW, "low": _CYAN}


def score_colour(score: int) -> str:
    return _RED if score >= 70 else _YELLOW if score >= 40 else _GREEN


def text_report(shown: DataFrame, config: Config, *, head: list[str], group_by: str | None = None, summary_only: bool = False, colour: bool = False) -> Iterator[str]:
    """Lines of a report: a flat table, or groups by skill or rule with their scores, the gravest first; one job either way."""
    yield from head
    if summary_only:
        return
    in_colour = lambda text, with_: f"{with_}{text}{_PLAIN}" if colour else text

    def row_text(r: Row) -> str:
        kind = "SEC" if r["classification"] == "security" else "INFO"
        severity, points = in_colour(f"{r['severity']:<7}", _SEVERITY_COLOURS[r["severity"]]), in_colour(f"{r['score']:>4}", score_colour(r["score"]))
        return f"{severity}{points}  {kind:<5}{r['rule_id']:<32}{r['skill']}  {r['evidence']['path']}:{r['evidence']['line'] or '-'}  {r['title']}"

    if group_by is None:
        yield from map(row_text, _ordered(shown))
        return
    key = {"skill": "skill", "rule": "rule_id"}[group_by]
    groups = score.overall_scores(shown, [key], config.least_rule_score).join(shown.groupBy(key).agg(F.max("score").alias("worst"), F.count("*").alias("n")), key)
    rows = shown.join(groups.select(F.col(key).alias("group_key"), "overall_score", "worst", "n"), F.col(key) == F.col("group_key"))
    last = None
    for r in rows.orderBy(F.desc("worst"), "group_key", F.desc("score"), "id").toLocalIterator():
        if r["group_key"] != last:
            last = r["group_key"]
            yield f"{last}: {r['n']} findings, score {in_colour(r['overall_score'], score_colour(r['overall_score']))}"
        yield "  " + row_text(r)

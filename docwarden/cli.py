"""Command line: scan, validate-config, init.  Exit codes: 0 fine, 1 a threshold is reached or the scan failed, 2 wrong use, 130 cancelled."""

from __future__ import annotations

import argparse
import difflib
import json
import sys
from collections.abc import Sequence
from dataclasses import replace
from pathlib import Path

import yaml
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docwarden import __version__
from docwarden import config as policy
from docwarden import rulepack, sinks
from docwarden.config import Config, ConfigError, Problem
from docwarden.engine import scan_workspace
from docwarden.plans import score

CONFIG_NAME = "docwarden.yaml"
_LISTS = ("allowlist_domains", "mcp_allowlist_domains", "denylist_domains", "mcp_denylist_domains")


#: command | long name | short name | kind or choices | help; "many" may be repeated; names in one "one of" group exclude each other
_OPTIONS = """
scan check | root | r | path! |
init | root | r | path |
scan check | rules-dir | R | path, one of source | folder of custom rules
scan check | rule-file | f | path many, one of source | a custom rule
scan check init | config | c | path | policy, else the one in the root
scan | output-dir | o | path | folder of reports; none are written without it
scan | mcp-allowlist | m | many | takes the place of the policy's list
scan | profile | p | strict/balanced/audit |
scan | no-cache | n | flag |
scan | rules-mode | | replace/overlay |
scan | duplicate-policy | | error/override |
scan | disable-rule | | many, one of chosen |
scan | only-rules | | many, one of chosen |
scan | max-file-mb | | number |
scan | output-format | | text | some of json, csv, sarif, with commas
scan | no-stdout | | flag |
scan | no-color | | flag | no colours, as where the output is no terminal
scan | verbose | v | flag |
scan | group-by | | skill/rule |
scan | fail-on | | high/medium/low |
scan | fail-on-score | | number |
scan | min-severity | | high/medium/low |
scan | summary-only | | flag |
scan | security-only | | flag |
scan | quiet-mode | | flag | JSON lines to a file and nothing to stdout
scan | quiet-output | | path |
init | yes | y | flag | don't ask
init | dry-run | | flag | print the policy only
init | from-scan | | path | reports of a scan, from which domains are suggested
"""
_DEFAULTS = {"output-format": "json", "rules-mode": "replace", "duplicate-policy": "error"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docwarden", description="Static risk analysis of instruction documents, on Spark")
    top.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    said = {"scan": ("scan", "scan a workspace"), "check": ("validate-config", "check the policy and custom rules without a scan"), "init": ("init", "write a starter policy")}
    parsers = {short: commands.add_parser(name, help=text) for short, (name, text) in said.items()}
    groups: dict[tuple[str, str], argparse._MutuallyExclusiveGroup] = {}
    for line in _OPTIONS.strip().splitlines():
        names, long, short, kind, text = (part.strip() for part in line.split("|"))
        kind, _, group = kind.partition(", one of ")
        settings: dict = {"help": text or None}
        if kind == "flag":
            settings["action"] = "store_true"
        else:
            settings["default"] = [] if kind == "many" else _DEFAULTS.get(long)
            if "many" in kind:
                settings["action"] = "append"
            if "/" in kind:
                settings["choices"] = kind.split("/")
            elif kind.startswith("path"):
                settings |= {"type": Path, "required": kind.endswith("!")}
            elif kind == "number":
                settings["type"] = int
        for name in names.split():
            if (name, long) == ("init", "root"):
                settings["default"] = Path(".")
            if group and (name, group) not in groups:
                groups[name, group] = parsers[name].add_mutually_exclusive_group()
            to = groups[name, group] if group else parsers[name]
            to.add_argument(*([f"-{short}"] if short else []), f"--{long}", **settings)
    return top


def _session() -> SparkSession:
    return SparkSession.builder.appName("docwarden").config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()


def _config_path(args: argparse.Namespace) -> Path:
    return args.config or args.root / CONFIG_NAME


def preflight(args: argparse.Namespace) -> list[Problem]:
    found = [] if args.root.is_dir() else [Problem("CFG010", str(args.root), "root", "no such folder")]
    found += policy.check_file(_config_path(args), required=args.config is not None)
    return found + rulepack.check_sources(args.rules_dir, args.rule_file)


def _say_problems(problems: list[Problem]) -> int:
    for p in problems:
        print(p, file=sys.stderr)
    return 2


def _settings(args: argparse.Namespace) -> Config:
    config = policy.load(_config_path(args))
    changes: dict = {}
    if args.profile:
        changes["profile"] = args.profile
    if args.mcp_allowlist:
        changes["mcp_allowlist_domains"] = tuple(sorted({policy.domain_or_url(x) for x in args.mcp_allowlist}))
    if args.max_file_mb is not None:
        if args.max_file_mb <= 0:
            raise ConfigError("--max-file-mb must be greater than 0")
        changes["max_file_mb"] = args.max_file_mb
    return replace(config, **changes)


def run_scan(args: argparse.Namespace) -> int:
    formats = [x.strip() for x in args.output_format.split(",") if x.strip()]
    if unknown := sorted(set(formats) - {"json", "csv", "sarif"}):
        raise ConfigError(f"unknown output formats: {', '.join(unknown)}")
    if args.fail_on_score is not None and not 0 <= args.fail_on_score <= 100:
        raise ConfigError("--fail-on-score must be from 0 to 100")
    if problems := preflight(args):
        return _say_problems(problems)
    config = _settings(args)
    quiet = args.quiet_mode or config.quiet.enabled
    to = args.quiet_output or (Path(config.quiet.output_path) if config.quiet.output_path else None)
    if quiet and to is None:
        raise ConfigError("quiet mode needs --quiet-output")
    if quiet and (args.output_dir or args.group_by or args.summary_only or formats != ["json"]):
        raise ConfigError("quiet mode goes with neither reports, output formats, groups nor --summary-only")
    rules = rulepack.load(args.rules_dir, args.rule_file, mode=args.rules_mode, duplicates=args.duplicate_policy)
    cache = None if args.no_cache or args.output_dir is None else str(args.output_dir.resolve() / ".docwarden-cache")
    result = scan_workspace(_session(), args.root, rules, config, disable=args.disable_rule, only=args.only_rules, cache=cache)
    shown = score.passing(result.findings, min_severity=args.min_severity, security_only=args.security_only)
    failed = score.gate_fails(result.findings, result.aggregate_score, fail_on=args.fail_on, fail_on_score=args.fail_on_score)
    about: dict = {"rules_executed": list(result.selection.executed), "rules_disabled": sorted(result.selection.disabled), "disable_sources": result.selection.disabled}
    if result.overrides:
        about["rule_overrides"] = result.overrides
    reasons = None
    if args.min_severity or args.security_only:
        reasons = score.filtered_reasons(result.findings, min_severity=args.min_severity, security_only=args.security_only).first().asDict()
        about["output_filter"] = {"min_severity": args.min_severity, "security_only": args.security_only} | reasons
    if quiet:
        n = shown.count()
        summary = {
            "schema_version": sinks.SCHEMA_VERSION, "scanned_files": result.scanned_files, "total_findings": result.total, "written_findings": n,
            "filtered_out_findings": result.total - n, "counts_by_severity": result.counts,
            "aggregate_severity": result.aggregate_severity, "aggregate_score": result.aggregate_score, "gate_scope": "all_findings", "gate_failed": failed, "duration_seconds": round(result.seconds, 3),
        }
        lines = sinks.json_lines(shown, result.warnings if config.quiet.include_warnings else [], summary if config.quiet.include_summary else None)
        sinks.write_json_lines(lines, to.resolve(), append=config.quiet.write_mode == "append")
        return int(failed)
    if args.output_dir:
        if "json" in formats:
            sinks.write_skill_reports(shown, result.findings, config, args.output_dir, about)
        if "csv" in formats:
            sinks.write_csv(shown, args.output_dir / "findings.csv")
        if "sarif" in formats:
            sinks.write_sarif(shown, args.output_dir / "findings.sarif", about)
    for w in result.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if not args.no_stdout:
        head = [
            f"{result.scanned_files} files in {result.seconds:.3f} s, {result.total} findings",
            f"score {result.aggregate_score} ({result.aggregate_severity}); high {result.counts['high']}, medium {result.counts['medium']}, low {result.counts['low']}",
        ]
        if reasons:
            head.append(f"shown {reasons['shown']} of {reasons['total']}; below severity {reasons['below_severity']}, informational {reasons['informational']}")
        if result.selection.disabled:
            head.append("rules off: " + ", ".join(f"{rule} ({source})" for rule, source in sorted(result.selection.disabled.items())))
        if args.verbose:
            head.append(f"cache: {result.cache_hits} hits, {result.cache_misses} misses; rules: {len(result.selection.executed)} run, {len(result.selection.disabled)} off")
        for line in sinks.text_report(shown, config, head=head, group_by=args.group_by, summary_only=args.summary_only, colour=sys.stdout.isatty() and not args.no_color):
            print(line)
        for hint in score.dominant_domains(result.findings).orderBy("rule_id").collect():
            print(f"hint: {hint['domain']} is in {hint['n']} of {hint['total']} {hint['rule_id']} findings; consider {score.ALLOWED_BY[hint['rule_id']]}", file=sys.stderr)
    return int(failed)


def _draft(suggested: dict[str, list[tuple[str, int]]]) -> str:
    lines = ["# Policy of docwarden", "profile: balanced"]
    for key in _LISTS:
        if suggested.get(key):
            lines += [f"{key}: []", "# seen in the scan; move up what is trusted", *(f"#   - {d}  # {n} findings" for d, n in suggested[key])]
        else:
            lines.append(f"{key}: []")
    lines += ["strict_subdomains: false", "ignore_default_allowlist: false", "max_file_mb: 2", "", "# more keys:", "# tool_prefixes: [MCP_]", "# detectors: {enabled: [], disabled: []}", "# typosquat: {baseline: []}"]
    return "\n".join(lines) + "\n"


def domains_of_reports(folder: Path) -> dict[str, list[tuple[str, int]]]:
    """Domains of the reports below a folder, the most frequent first, under the keys that would allow them."""
    if not folder.is_dir():
        raise ConfigError(f"{folder}: no such folder")
    kinds = "rule_id string, description string, evidence struct<path:string,line:int,snippet:string>"
    rows = _session().read.schema(kinds).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "findings.json").json(str(folder))
    counts = score.domain_counts(rows.filter("rule_id is not null")).orderBy(F.desc("n"), "domain").collect()
    return {key: [(r["domain"], r["n"]) for r in counts if r["rule_id"] == rule] for rule, key in score.ALLOWED_BY.items()}


def run_init(args: argparse.Namespace) -> int:
    if not args.root.is_dir():
        return _say_problems([Problem("CFG010", str(args.root), "root", "no such folder")])
    path = _config_path(args)
    text = _draft(domains_of_reports(args.from_scan) if args.from_scan else {})
    if problems := policy.check(yaml.safe_load(text), str(path)):
        return _say_problems(problems)
    if args.dry_run:
        print(text, end="")
        return 0
    old = path.read_text(encoding="utf-8") if path.is_file() else ""
    if old and not args.yes:
        sys.stdout.writelines(difflib.unified_diff(old.splitlines(True), text.splitlines(True), str(path), "new"))
    if not args.yes:
        try:
            answer = input(f"write {path}? [y/N] ")
        except (EOFError, KeyboardInterrupt):
            return 130
        if answer.strip().lower() not in ("y", "yes"):
            return 130
    sinks._whole(path, lambda out: out.write(text))
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "scan":
            return run_scan(args)
        if args.command == "init":
            return run_init(args)
        if problems := preflight(args):
            return _say_problems(problems)
        print(json.dumps({"valid": True}))
        return 0
    except ConfigError as error:
        print(error, file=sys.stderr)
        return 2
    except (OSError, PySparkException, Py4JError) as error:
        print(f"scan failed: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

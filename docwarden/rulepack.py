"""Declarative rules: loading, checking, composition, selection."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import yaml

from docwarden.config import Config, ConfigError, Problem

BUNDLED = Path(__file__).parent / "rules"
REMOTE_RULES = ("MCP_REMOTE_DENYLIST", "MCP_REMOTE_NON_HTTPS", "MCP_REMOTE_RAW_IP")
STRATEGIES = (
    "bidi_control_scan", "bundled_scripts_check", "confusable_identifier_scan", "data_sensitivity_check", "entropy_check", "field_pattern_match",
    "frontmatter_check", "hidden_instruction_scan", "hint_count", "ip_address_scan", "key_pattern_match", "keyword_in_text", "payload_decode_scan",
    "remote_reference_scan", "token_scan", "typosquat_check", "url_domain_filter",
)
_SOURCES = ("fields", "file_system", "frontmatter", "keys", "raw_text")
_NEEDED = ("match", "metadata", "rule_id", "scoring", "version")
_ALLOWED = (*_NEEDED, "dedupe", "profiles", "public_rule_id")
_METADATA = ("classification", "confidence", "description", "description_template", "recommendation", "title")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    public_id: str
    strategy: str
    match: dict[str, Any]
    metadata: dict[str, Any]
    base_score: int
    dedupe: bool = True
    profiles: dict[str, dict[str, int]] = field(default_factory=dict)
    source: str = ""

    @property
    def classification(self) -> str:
        return self.metadata.get("classification", "security")

    @property
    def template(self) -> str:
        return self.metadata.get("description_template", self.metadata.get("description", ""))

    @property
    def description(self) -> str:
        return self.metadata.get("description", "")

    def score(self, config: Config) -> int:
        return int(self.profiles.get(config.profile, {}).get("score_override", self.base_score))


def check(data: Any, path: str) -> list[Problem]:
    """All problems of one parsed rule."""
    if not isinstance(data, dict):
        return [Problem("RULE004", path, "", "a rule must be a mapping")]
    found = [Problem("RULE005", path, str(k), f"unknown key {k!r}") for k in sorted(map(str, data)) if k not in _ALLOWED]
    found += [Problem("RULE006", path, k, "is needed") for k in _NEEDED if k not in data]

    def wrong(name: str, message: str) -> None:
        found.append(Problem("RULE007", path, name, message))

    def mapping(name: str) -> dict[str, Any]:
        if name in data and not isinstance(data[name], dict):
            wrong(name, "must be a mapping")
        return data[name] if isinstance(data.get(name), dict) else {}

    for key in ("rule_id", "public_rule_id"):
        if key in data and not (isinstance(data[key], str) and data[key].strip()):
            wrong(key, "must be a string that isn't empty")
    if "version" in data and (isinstance(data["version"], bool) or data["version"] != 1):
        wrong("version", "must be 1")
    if "dedupe" in data and not isinstance(data["dedupe"], bool):
        wrong("dedupe", "must be true or false")
    if meta := mapping("metadata"):
        found.extend(Problem("RULE005", path, f"metadata.{k}", f"unknown key {k!r}") for k in sorted(map(str, meta)) if k not in _METADATA)
        found.extend(Problem("RULE006", path, f"metadata.{k}", "is needed") for k in ("confidence", "recommendation", "title") if k not in meta)
        if not {"description", "description_template"} & set(meta):
            found.append(Problem("RULE006", path, "metadata.description", "a description or a description_template is needed"))
        for key, allowed in (("confidence", ("low", "medium", "high")), ("classification", ("security", "informational"))):
            if key in meta and meta[key] not in allowed:
                wrong(f"metadata.{key}", f"must be one of {', '.join(allowed)}")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 100
    if scoring := mapping("scoring"):
        if "base_score" not in scoring:
            found.append(Problem("RULE006", path, "scoring.base_score", "is needed"))
        elif not whole(scoring["base_score"]):
            wrong("scoring.base_score", "must be a whole number from 0 to 100")
    if match := mapping("match"):
        for key, allowed in (("source", _SOURCES), ("strategy", STRATEGIES)):
            if key not in match:
                found.append(Problem("RULE006", path, f"match.{key}", "is needed"))
            elif match[key] not in allowed:
                wrong(f"match.{key}", f"must be one of {', '.join(allowed)}")
    for profile, inner in mapping("profiles").items():
        if profile not in ("strict", "balanced", "audit"):
            wrong(f"profiles.{profile}", "unknown profile")
        elif not isinstance(inner, dict) or set(inner) - {"score_override"} or not all(map(whole, inner.values())):
            wrong(f"profiles.{profile}", "may hold score_override, a whole number from 0 to 100")
    return sorted(found, key=lambda p: (p.code, p.field, p.message))


def compile_rule(data: dict[str, Any], source: str = "<rule>") -> Rule:
    if problems := check(data, source):
        raise ConfigError("; ".join(map(str, problems)))
    match = dict(data["match"])
    return Rule(
        rule_id=data["rule_id"], public_id=data.get("public_rule_id", data["rule_id"]), strategy=match["strategy"], match=match, metadata=dict(data["metadata"]),
        profiles=data.get("profiles", {}), dedupe=data.get("dedupe", True), source=source, base_score=data["scoring"]["base_score"],
    )


def find_rule(rules: Sequence[Rule], rule_id: str) -> Rule:
    """The rule of an internal id, else the only one of a public id."""
    for rule in rules:
        if rule.rule_id == rule_id:
            return rule
    public = [rule for rule in rules if rule.public_id == rule_id]
    if len(public) > 1:
        raise ConfigError(f"{rule_id} stands for several rules; name one of {', '.join(sorted(r.rule_id for r in public))}")
    if not public:
        raise ConfigError(f"{rule_id}: no such rule is loaded")
    return public[0]


def paths_of(rules_dir: Path | None = None, rule_files: Sequence[Path] | None = None) -> tuple[list[Path], list[Problem]]:
    """Files of custom rules, and what is wrong with how they are named."""
    if rules_dir is not None and rule_files:
        return [], [Problem("RULE009", "", "", "give a folder of rules or files of rules, not both")]
    if rules_dir is not None:
        if not rules_dir.is_dir():
            return [], [Problem("RULE001", str(rules_dir), "", "no such folder")]
        return sorted(rules_dir.resolve().glob("*.yaml")), []
    found, problems = [], []
    for path in rule_files or ():
        if not path.is_file():
            problems.append(Problem("RULE001", str(path), "", "no such file"))
        elif path.suffix.lower() != ".yaml":
            problems.append(Problem("RULE002", str(path), "", "must end in .yaml"))
        else:
            found.append(path.resolve())
    return found, problems


def check_sources(rules_dir: Path | None = None, rule_files: Sequence[Path] | None = None) -> list[Problem]:
    """All problems of all custom rules."""
    paths, found = paths_of(rules_dir, rule_files)
    seen: dict[str, Path] = {}
    for path in paths:
        try:
            data = yaml.safe_load(path.read_text(encoding="utf-8"))
        except (yaml.YAMLError, UnicodeDecodeError) as error:
            found.append(Problem("RULE003", str(path), "", f"can't be parsed: {' '.join(str(error).split())}"))
            continue
        found += check(data, str(path))
        name = data.get("rule_id") if isinstance(data, dict) else None
        if isinstance(name, str) and name in seen:
            found.append(Problem("RULE008", str(path), "rule_id", f"{name} is in {seen[name]} too"))
        elif isinstance(name, str):
            seen[name] = path
    return found


def load(rules_dir: Path | None = None, rule_files: Sequence[Path] | None = None, *, mode: str = "replace", duplicates: str = "error") -> list[Rule]:
    """Rules in the order of their ids.

    Custom rules stand in for the bundled ones, or with mode ``overlay`` beside
    them; there a custom rule may take a bundled one's place if ``duplicates`` is
    ``override``.
    """
    custom, problems = paths_of(rules_dir, rule_files)
    if problems:
        raise ConfigError("; ".join(map(str, problems)))
    if duplicates == "override" and mode != "overlay":
        raise ConfigError("duplicates can only be overridden in overlay mode")
    bundled = sorted(BUNDLED.glob("*.yaml")) if mode == "overlay" or (rules_dir is None and not rule_files) else []
    loaded: dict[str, Rule] = {}
    for path in [*bundled, *custom]:
        try:
            data = yaml.safe_load(path.read_text(encoding="utf-8"))
        except (yaml.YAMLError, UnicodeDecodeError) as error:
            raise ConfigError(f"{path}: can't be parsed: {error}") from error
        rule = compile_rule(data, str(path))
        if rule.rule_id in loaded:
            over_bundled = path not in bundled and Path(loaded[rule.rule_id].source) in bundled
            if not (mode == "overlay" and duplicates == "override" and over_bundled):
                raise ConfigError(f"{rule.rule_id} is in {loaded[rule.rule_id].source} and {path}")
        loaded[rule.rule_id] = rule
    if not loaded:
        raise ConfigError("there are no rules")
    return sorted(loaded.values(), key=lambda r: (r.rule_id, r.public_id, r.source))


def fingerprint(rules: Iterable[Rule]) -> str:
    """Digest of all that the rules say."""
    return hashlib.sha256(json.dumps([asdict(r) for r in rules], sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Selection:
    executed: tuple[str, ...]
    #: disabled public id -> config, cli-disable or cli-only
    disabled: dict[str, str]
    warnings: tuple[str, ...]


def select(rules: Iterable[Rule], config: Config, *, disable: Sequence[str] = (), only: Sequence[str] = ()) -> Selection:
    """Which public ids run: ``only`` goes before ``disable`` and the configuration; the remote checks count as rules."""
    known = tuple(sorted({r.public_id for r in rules} | set(REMOTE_RULES)))
    for flag, ids in (("disabled", disable), ("selected", only)):
        if missing := sorted(set(ids) - set(known)):
            raise ConfigError(f"unknown rules are {flag}: {', '.join(missing)}")
    named = {"detectors.enabled": config.enabled, "detectors.disabled": config.disabled, "rule_overrides": config.overrides}
    warnings = tuple(f"{key} names unknown rules: {', '.join(x)}" for key, ids in named.items() if (x := sorted(set(ids) - set(known) - {"*"})))
    if only:
        return Selection(tuple(r for r in known if r in only), {r: "cli-only" for r in known if r not in only}, warnings)
    off = {r for r, o in config.overrides.items() if o.enabled is False} | (set(known) if "*" in config.disabled else set(config.disabled))
    if config.enabled and "*" not in config.enabled:
        off |= set(known) - set(config.enabled)
    disabled = {r: "config" if r in off else "cli-disable" for r in known if r in off or r in disable}
    return Selection(tuple(r for r in known if r not in disabled), disabled, warnings)

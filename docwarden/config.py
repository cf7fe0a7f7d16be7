"""Policy configuration: loading, checking, fingerprint."""

from __future__ import annotations

import dataclasses
import difflib
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import urlparse

import yaml

from docwarden import terms

SEVERITIES = ("low", "medium", "high")
#: key -> kind of its value
_KEYS = {
    "profile": "profile", "allowlist_domains": "strings", "ignore_default_allowlist": "bool", "strict_subdomains": "bool", "denylist_domains": "strings",
    "mcp_allowlist_domains": "strings", "mcp_denylist_domains": "strings", "tool_prefixes": "strings", "detectors": "detectors", "typosquat": "typosquat",
    "tool_tier_keywords": "tiers", "data_sensitivity": "sensitivity", "rule_overrides": "overrides", "skill_globs": "strings", "max_file_mb": "megabytes", "quiet_mode": "quiet",
}
_NESTED = {
    "detectors": {"enabled": "strings", "disabled": "strings"},
    "typosquat": {"baseline": "strings"},
    "tiers": {"destructive": "strings", "write": "strings"},
    "sensitivity": {"high_services": "strings", "medium_services": "strings", "low_services": "strings", "high_keywords": "strings", "medium_keywords": "strings", "service_categories": "mapping"},
    "quiet": {"enabled": "bool", "output_path": "string", "format": "jsonl", "include_warnings": "bool", "include_summary": "bool", "write_mode": "write_mode"},
}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Problem:
    """One finding of validation; ``code`` is stable."""

    code: str
    #: the file
    path: str
    field: str
    #: what is wrong, and what to do about it
    message: str
    hint: str = ""

    def __str__(self) -> str:
        return f"{self.code} {self.path}: {self.field}: {self.message}" + (f" ({self.hint})" if self.hint else "")


@dataclass(frozen=True)
class Override:
    enabled: bool | None = None
    min_severity: str | None = None
    max_severity: str | None = None


@dataclass(frozen=True)
class Quiet:
    enabled: bool = False
    output_path: str | None = None
    format: str = "jsonl"
    include_warnings: bool = True
    include_summary: bool = True
    write_mode: str = "overwrite"


@dataclass(frozen=True)
class Sensitivity:
    services: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(terms.SERVICES))
    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(terms.KEYWORDS))
    categories: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    profile: str = "balanced"
    strict_subdomains: bool = False
    allowlist_domains: tuple[str, ...] = ()
    denylist_domains: tuple[str, ...] = ()
    #: without it, the built-in domains are allowed too
    ignore_default_allowlist: bool = False
    #: the same for endpoints of servers
    mcp_denylist_domains: tuple[str, ...] = ()
    mcp_allowlist_domains: tuple[str, ...] = ()
    tool_prefixes: tuple[str, ...] = terms.TOOL_PREFIXES
    enabled: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    typosquat_baseline: tuple[str, ...] = ()
    destructive: tuple[str, ...] = terms.DESTRUCTIVE_TIER
    write: tuple[str, ...] = terms.WRITE_TIER
    sensitivity: Sensitivity = field(default_factory=Sensitivity)
    overrides: dict[str, Override] = field(default_factory=dict)
    skill_globs: tuple[str, ...] = ("**/SKILL.md",)
    max_file_mb: int = 2
    quiet: Quiet = field(default_factory=Quiet)

    @property
    def high_from(self) -> int:
        return terms.PROFILES[self.profile][0]

    @property
    def medium_from(self) -> int:
        return terms.PROFILES[self.profile][1]

    @property
    def least_rule_score(self) -> int:
        return terms.PROFILES[self.profile][2]

    @property
    def suppress_local_hosts(self) -> bool:
        return terms.PROFILES[self.profile][3]

    @property
    def allowed_domains(self) -> tuple[str, ...]:
        own = set(self.allowlist_domains)
        return tuple(sorted(own if self.ignore_default_allowlist else own | set(terms.DEFAULT_ALLOWED_DOMAINS)))

    def fingerprint(self) -> str:
        """Digest of everything that findings depend on."""
        data = dataclasses.asdict(self)
        del data["quiet"]
        return hashlib.sha256(json.dumps(data, sort_keys=True, default=str).encode()).hexdigest()


def domains(values: list[str]) -> tuple[str, ...]:
    return tuple(sorted({v.strip().lower() for v in values if v.strip()}))


def domain_or_url(value: str) -> str:
    """Host of a URL, or the domain itself, in lower case."""
    text = value.strip().lower()
    host = urlparse(text if "://" in text else f"//{text}").hostname if text else None
    if not host:
        raise ConfigError(f"no domain in {value!r}")
    return host


def check(data: Any, path: str) -> list[Problem]:
    """All problems of a parsed configuration, in order of code and field."""
    if data is None:
        return []
    if not isinstance(data, dict):
        return [Problem("CFG003", path, "", "the top level must be a mapping")]
    found: list[Problem] = []

    def say(code: str, name: str, message: str, hint: str = "") -> None:
        found.append(Problem(code, path, name, message, hint))

    def unknown(code: str, name: str, key: Any, known: Any) -> None:
        near = difflib.get_close_matches(str(key), list(known), n=1)
        say(code, name, f"unknown key {key!r}", f"did you mean {near[0]!r}?" if near else "")

    def value(kind: str, name: str, given: Any) -> None:
        if kind == "strings":
            if not isinstance(given, list):
                say("CFG005", name, "must be a list of strings")
            else:
                for i, item in enumerate(given):
                    if not isinstance(item, str):
                        say("CFG005", f"{name}[{i}]", "must be a string")
        elif kind == "bool":
            if not isinstance(given, bool):
                say("CFG005", name, "must be true or false")
        elif kind == "string":
            if not isinstance(given, str) or not given.strip():
                say("CFG005", name, "must be a string that isn't empty")
        elif kind == "mapping":
            if not isinstance(given, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in given.items()):
                say("CFG009", name, "must map strings to strings")
        elif kind == "megabytes":
            if not isinstance(given, int) or isinstance(given, bool):
                say("CFG005", name, "must be a whole number")
            elif given <= 0:
                say("CFG007", name, "must be greater than 0")
        elif kind in ("profile", "jsonl", "write_mode"):
            allowed = {"profile": tuple(terms.PROFILES), "jsonl": ("jsonl",), "write_mode": ("overwrite", "append")}[kind]
            if not isinstance(given, str):
                say("CFG005", name, "must be a string")
            elif given not in allowed:
                say("CFG006", name, f"must be one of {', '.join(allowed)}")
        elif kind == "overrides":
            overrides(name, given)
        else:
            if not isinstance(given, dict):
                say("CFG009", name, "must be a mapping")
                return
            for key, inner in given.items():
                if key in _NESTED[kind]:
                    value(_NESTED[kind][key], f"{name}.{key}", inner)
                else:
                    unknown("CFG004", name, key, _NESTED[kind])
            if kind == "detectors":
                both = {x for x in given.get("enabled") or [] if isinstance(x, str)} & {x for x in given.get("disabled") or [] if isinstance(x, str)}
                for rule in sorted(both - {"*"}):
                    say("CFG008", name, f"{rule} is enabled and disabled")
            if kind == "quiet" and given.get("enabled") is True and not given.get("output_path"):
                say("CFG011", f"{name}.output_path", "is needed when quiet mode is enabled")

    def overrides(name: str, given: Any) -> None:
        if not isinstance(given, dict):
            say("CFG009", name, "must be a mapping")
            return
        for rule, inner in given.items():
            if not isinstance(inner, dict):
                say("CFG009", f"{name}.{rule}", "must be a mapping")
                continue
            for key, setting in inner.items():
                if key == "enabled":
                    value("bool", f"{name}.{rule}.enabled", setting)
                elif key in ("min_severity", "max_severity"):
                    if setting not in SEVERITIES:
                        say("CFG006", f"{name}.{rule}.{key}", f"must be one of {', '.join(SEVERITIES)}")
                else:
                    unknown("CFG004", f"{name}.{rule}", key, ("enabled", "min_severity", "max_severity"))
            low, high = inner.get("min_severity"), inner.get("max_severity")
            if low in SEVERITIES and high in SEVERITIES and SEVERITIES.index(low) > SEVERITIES.index(high):
                say("CFG007", f"{name}.{rule}", "min_severity is above max_severity")

    for key, given in data.items():
        if key not in _KEYS:
            unknown("CFG004", str(key), key, _KEYS)
        elif given is not None:
            value(_KEYS[key], key, given)
    return sorted(found, key=lambda p: (p.code, p.field, p.message))


def check_file(path: Path, *, required: bool = True) -> list[Problem]:
    if not path.is_file():
        return [Problem("CFG001", str(path), "", "no such file")] if required else []
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (yaml.YAMLError, UnicodeDecodeError) as error:
        return [Problem("CFG002", str(path), "", f"can't be parsed: {' '.join(str(error).split())}")]
    return check(data, str(path))


def from_mapping(data: dict[str, Any] | None) -> Config:
    """Configuration of a mapping that :func:`check` accepts."""
    if problems := check(data, "config"):
        raise ConfigError("; ".join(map(str, problems)))
    data = {k: v for k, v in (data or {}).items() if v is not None}
    settings: dict[str, Any] = {k: data[k] for k in ("profile", "ignore_default_allowlist", "strict_subdomains", "max_file_mb") if k in data}
    for key in ("allowlist_domains", "denylist_domains", "mcp_allowlist_domains", "mcp_denylist_domains"):
        settings[key] = domains(data.get(key, []))
    if data.get("tool_prefixes"):
        settings["tool_prefixes"] = tuple(p.strip().upper() for p in data["tool_prefixes"] if p.strip())
    if data.get("skill_globs"):
        settings["skill_globs"] = tuple(data["skill_globs"])
    detectors = data.get("detectors", {})
    settings["enabled"], settings["disabled"] = (tuple(x for x in detectors.get(k) or []) for k in ("enabled", "disabled"))
    settings["typosquat_baseline"] = tuple(x.strip() for x in data.get("typosquat", {}).get("baseline") or [] if x.strip())
    for key in ("destructive", "write"):
        if given := data.get("tool_tier_keywords", {}).get(key):
            settings[key] = tuple(x.strip().upper() for x in given if x.strip())
    if given := data.get("data_sensitivity"):
        lower = lambda key, default: tuple(x.strip().lower() for x in given.get(key) or default if x.strip())
        settings["sensitivity"] = Sensitivity(
            {tier: lower(f"{tier}_services", terms.SERVICES[tier]) for tier in terms.SERVICES},
            {tier: lower(f"{tier}_keywords", terms.KEYWORDS[tier]) for tier in terms.KEYWORDS},
            {k.lower(): v for k, v in (given.get("service_categories") or {}).items()},
        )
    settings["overrides"] = {rule: Override(**inner) for rule, inner in data.get("rule_overrides", {}).items()}
    settings["quiet"] = Quiet(**data.get("quiet_mode", {}))
    return Config(**settings)


def load(path: Path | None) -> Config:
    """Configuration of a file; the defaults for None or a file that isn't there."""
    if path is None or not path.is_file():
        return Config()
    if problems := check_file(path):
        raise ConfigError("\n".join(map(str, problems)))
    return from_mapping(yaml.safe_load(path.read_text(encoding="utf-8")))

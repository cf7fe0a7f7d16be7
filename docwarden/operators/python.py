"""Operators that need Python: Unicode names, decoders, IPv6.

All of them run in one Arrow UDF pass, which gets a text only if an expression in
the JVM has found something in it that they look for; the rest is sent as null.
"""

from __future__ import annotations

import base64
import binascii
import ipaddress
import re
import unicodedata
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden import terms
from docwarden.config import Config
from docwarden.functions import net
from docwarden.functions.text import code, entropies
from docwarden.model import SIGNAL
from docwarden.operators.fields import column_of, entropy_values, no_signals
from docwarden.rulepack import Rule

_BOM = chr(0xFEFF)
_LOOKALIKE = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in terms.CONFUSABLE_RANGES)
_CAPITALS = re.compile(rf"\b[A-Z{_LOOKALIKE}][A-Z0-9_{_LOOKALIKE}]{{2,}}\b")
_IDENTIFIER = re.compile(rf"\b[A-Za-z{_LOOKALIKE}][\w.\-{_LOOKALIKE}]{{2,}}\b".replace(r"\w", "A-Za-z0-9_"))
_ANY_LOOKALIKE = re.compile(f"[{_LOOKALIKE}]")
_URL = re.compile(r"(?i)https?://[^\s\"'<>]+")
_COMMENT = re.compile(r"(?s)<!--(.*?)-->")
_ENCODED = {
    "base64": (re.compile(r"[A-Za-z0-9+/\-_]{20,}={0,2}"), 20),
    "hex": (re.compile(r"(?:0x)?(?:[0-9A-Fa-f]{2}){8,}"), 16),
    "unicode-escape": (re.compile(r"(?:\\u[0-9A-Fa-f]{4}){4,}"), 0),
}
_classes = lambda points: "".join(code(p) for p in points)
_RANGES = "".join(f"{code(lo)}-{code(hi)}" for lo, hi in terms.CONFUSABLE_RANGES)
#: strategy -> pattern without which it can't find anything
TRIGGERS = {
    "hidden_instruction_scan": rf"[{_classes(terms.ZERO_WIDTH)}{_RANGES}]|<!--|(?<=(?s:.))\x{{FEFF}}",
    "bidi_control_scan": f"[{_classes(terms.BIDI_NAMES)}]",
    "confusable_identifier_scan": f"[{_RANGES}]",
    # tried where a run begins only
    "payload_decode_scan": r"(?<![A-Za-z0-9+/\-_])[A-Za-z0-9+/\-_]{20}|(?<![0-9A-Fa-f])[0-9A-Fa-f]{16}|(?:\\u[0-9A-Fa-f]{4}){4}",
}
Signal = tuple[int, str, str, int, str]


def _char_name(ch: str) -> str:
    return unicodedata.name(ch, f"U+{ord(ch):04X}")


def _listed(labels: list[str], n: int = 5) -> str:
    return "; ".join(labels[:n]) + (f" (+{len(labels) - n} more)" if len(labels) > n else "")


def mixed_names(token: str) -> list[str]:
    """Names of the look-alike characters of a token that has ASCII characters too, else nothing."""
    odd = {c for c in token if _ANY_LOOKALIKE.match(c)}
    return sorted({_char_name(c) for c in odd}) if odd and any(c < "\x80" for c in token) else []


def _host(url: str) -> str:
    try:
        return urlparse(url).hostname or ""
    except ValueError:
        return ""


def hidden_signals(raw: str, rule: Rule, score: int) -> Iterator[Signal]:
    labels: list[str] = []
    places: list[tuple[int, str]] = []
    lines = list(enumerate(raw.splitlines(), 1))
    invisible = {c for c in raw if ord(c) in terms.ZERO_WIDTH}
    if invisible:
        labels.append(f"zero-width characters ({', '.join(sorted(map(_char_name, invisible)))})")
        places.append(next(((n, repr(line.strip())) for n, line in lines if invisible & set(line)), (1, "")))
    if raw.find(_BOM, 1) >= 1:
        labels.append("embedded BOM (U+FEFF) in body text")
        places.append(next(((n, repr(line.strip())) for n, line in lines if line.find(_BOM) >= (n == 1)), (1, "")))
    for comment in _COMMENT.finditer(raw):
        body = comment.group(1).lower().strip()
        if any(p in body for p in terms.HIDDEN_PHRASES):
            labels.append("HTML comment with injection phrases: '" + body[:60].replace("\n", " ") + "'")
            places.append((raw.count("\n", 0, comment.start()) + 1, comment.group()))
    seen: dict[str, str] = {}
    spoofed: list[tuple[int, str]] = []
    for n, line in lines:
        if not _ANY_LOOKALIKE.search(line):
            continue
        tokens = [t for t in _CAPITALS.findall(line) if mixed_names(t)]
        for t in tokens:
            seen.setdefault(t, "token")
        if tokens or any(mixed_names(_host(u)) for u in _URL.findall(line)):
            spoofed.append((n, line.strip()))
    for host in map(_host, _URL.findall(raw)):
        if mixed_names(host):
            seen.setdefault(host, "domain")
    labels += [f"confusable/homoglyph {kind} '{t}' ({', '.join(mixed_names(t))})" for t, kind in seen.items()]
    if seen:
        places.append(spoofed[0] if spoofed else (1, ""))
    if labels and len(labels) >= rule.match.get("min_signals", 1):
        yield score, rule.metadata["confidence"], f"{rule.description} Detected: {'; '.join(labels)}.", places[0][0] or 1, places[0][1][: terms.SNIPPET]


def bidi_signals(raw: str, rule: Rule, score: int) -> Iterator[Signal]:
    fence, depth, base, labels, place = "", 0, score, [], None
    shown = lambda c: f"U+{ord(c):04X} {terms.BIDI_NAMES[ord(c)]}"
    for n, line in enumerate(raw.splitlines(), 1):
        mark = line.strip()[:3]
        if mark in ("```", "~~~"):
            fence = mark if not fence else "" if mark == fence else fence
        marks = [c for c in line if ord(c) in terms.BIDI_NAMES]
        if not marks:
            continue
        labels.append(f"line {n}: {', '.join(map(shown, dict.fromkeys(marks)))}")
        place = place or (n, "".join(f"[{shown(c)}]" if ord(c) in terms.BIDI_NAMES else c for c in line).strip())
        if fence:
            score = max(score, min(100, base + 7))
        for c in marks:
            kind = terms.BIDI_NAMES[ord(c)]
            depth += 1 if kind in ("LRO", "RLO") else -1 if kind == "PDF" and depth else 0
    if place and len(labels) >= rule.match.get("min_signals", 1):
        yield min(100, score + 5) if depth else score, rule.metadata["confidence"], f"{rule.description} Detected: {_listed(labels)}.", place[0], place[1][: terms.SNIPPET]


def confusable_signals(raw: str, entries: Iterable[dict], body_start: int, rule: Rule, score: int) -> Iterator[Signal]:
    least, keys = rule.match.get("min_length", 3), rule.match.get("frontmatter_keys", terms.SPOOFED_KEYS)
    lines = raw.lstrip(_BOM).splitlines()
    marks: dict[str, tuple[str, int, bool]] = {}

    def add(token: str, label: str, line: int, declared: bool = False) -> None:
        if token not in marks:
            marks[token] = (f"{label}: confusable '{token}' ({', '.join(mixed_names(token))})", line, declared)

    plain_start = not raw.startswith(_BOM)
    for e in entries:
        if e["key"].rsplit(".", 1)[-1].lower() in keys:
            for t in _IDENTIFIER.findall(e["value"]):
                if len(t) >= least and mixed_names(t):
                    at = next((n for n, line in enumerate(lines[1 : max(1, body_start - 1)], 2) if t in line), 1) if plain_start else 1
                    add(t, f"frontmatter '{e['key']}'", at, True)
    body = "\n".join(lines[body_start:]).strip()
    first = body_start + 1 if plain_start else 1
    for n, line in enumerate(body.splitlines(), first):
        if _ANY_LOOKALIKE.search(line):
            for t in _IDENTIFIER.findall(line):
                if len(t) >= least and mixed_names(t):
                    add(t, f"body line {n}", n)
    for m in _URL.finditer(body):
        host = _host(m.group())
        if mixed_names(host):
            add(host, "URL hostname", body.count("\n", 0, m.start()) + first)
    if marks and len(marks) >= rule.match.get("min_signals", 1):
        token, (_, line, _) = next(iter(marks.items()))
        snippet = "".join(f"[U+{ord(c):04X} {_char_name(c)}]" if _ANY_LOOKALIKE.match(c) else c for c in token)
        total = min(100, score + 5) if any(d for *_, d in marks.values()) else score
        yield total, rule.metadata["confidence"], f"{rule.description} Detected: {_listed([x for x, *_ in marks.values()])}.", line, snippet[: terms.SNIPPET]


def _decoded(kind: str, block: str, longest: int) -> str | None:
    """Readable text that a block stands for, or None."""

    def attempts() -> Iterator[bytes]:
        if kind == "hex":
            yield bytes.fromhex(block.removeprefix("0x"))
        elif kind == "base64":
            padded = block + "=" * (-len(block) % 4)
            for decode in (base64.b64decode, base64.urlsafe_b64decode):
                try:
                    yield decode(padded)
                except binascii.Error:
                    continue

    if kind == "unicode-escape":
        texts: Iterable[str] = [block.encode().decode("unicode_escape")]
    else:
        texts = []
        for data in attempts():
            if len(data) > longest:
                return None
            try:
                texts.append(data.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    for text in texts:
        readable = sum(c.isprintable() or c in "\n\r\t" for c in text)
        if 4 <= len(text) <= longest and readable >= 0.7 * len(text):
            return text
    return None


def payload_signals(raw: str, rule: Rule, score: int) -> Iterator[Signal]:
    match = rule.match
    left, longest = match.get("max_candidates", 50), match.get("max_decode_length", 4096)
    strong, weak = match.get("strong_hints", terms.PAYLOAD_STRONG), match.get("weak_hints", terms.PAYLOAD_WEAK)
    told: set[int] = set()
    for kind, (pattern, least) in _ENCODED.items():
        for block in pattern.finditer(raw):
            if left <= 0:
                return
            if len(block.group().removeprefix("0x") if kind == "hex" else block.group()) < least:
                continue
            text = _decoded(kind, block.group(), longest)
            if text is None:
                continue
            left -= 1
            low = text.lower()
            strong_found = [h for h in strong if h in low]
            found = strong_found + [h for h in weak if h in low]
            line = raw.count("\n", 0, block.start()) + 1
            if len(found) < match.get("min_hint_matches", 2) or (match.get("require_strong", True) and not strong_found) or line in told:
                continue
            told.add(line)
            text = f"{rule.description} {kind}-encoded block on line {line} decodes to injection hints: {_listed(found, 3)}."
            yield score, rule.metadata["confidence"], text, line, f"{kind}: {block.group()[:60]}... decodes to [{', '.join(found[:2])}]"[: terms.SNIPPET]


_FIELDS = ("score", "confidence", "description", "line", "snippet")


def _udf(rule: Rule, score: int):
    """UDF of one rule over (text or null, front matter entries, lines before the body)."""

    @F.pandas_udf(f"array<{SIGNAL}>")
    def find(raw: pd.Series, entries: pd.Series, body_start: pd.Series) -> pd.Series:
        out = []
        for text, kv, start in zip(raw, entries, body_start):
            if text is None:
                out.append([])
                continue
            if rule.strategy == "hidden_instruction_scan":
                found = hidden_signals(text, rule, score)
            elif rule.strategy == "bidi_control_scan":
                found = bidi_signals(text, rule, score)
            elif rule.strategy == "payload_decode_scan":
                found = payload_signals(text, rule, score)
            else:
                found = confusable_signals(text, [] if kv is None else kv, int(start), rule, score)
            out.append([dict(zip(_FIELDS, s)) for s in found])
        return pd.Series(out)

    return find


def of_rule(rule: Rule, config: Config) -> Column:
    """What :func:`with_python` has found for the rule."""
    return F.coalesce(F.col(f"`{column_of(rule)}`"), no_signals())


def _dense(least: float):
    """UDF that keeps of each array of values those with at least so many bits a character."""

    @F.pandas_udf("array<string>")
    def keep(values: pd.Series) -> pd.Series:
        lists = [() if v is None else v for v in values]
        bits = iter(entropies([t for of in lists for t in of]))
        return pd.Series([[t for t in of if next(bits) >= least] if len(of) else None for of in lists])

    return keep


def _ipv6(tokens: pd.Series) -> pd.Series:
    out = []
    for found in tokens:
        known = {}
        for t in () if found is None else found:
            try:
                a = ipaddress.IPv6Address(t)
            except ValueError:
                continue
            closed = a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified
            known[t] = {"text": a.compressed, "closed": closed, "global": a.is_global}
        out.append(known)
    return pd.Series(out)


def ipv6_of(tokens: Column) -> Column:
    """Map from each of the tokens that is an IPv6 address to what it is; null where there are none."""
    kind = "map<string,struct<text:string,closed:boolean,global:boolean>>"
    return F.pandas_udf(_ipv6, kind)(F.when(F.size(tokens) > 0, tokens))


def with_python(parsed: DataFrame, rules: Iterable[Rule], config: Config) -> DataFrame:
    """Adds what the rules' operators find in Python, and ``ipv6`` if a rule needs it."""
    added: dict[str, Column] = {}
    for rule in rules:
        if rule.strategy in TRIGGERS:
            gated = F.when(F.col("raw_text").rlike(TRIGGERS[rule.strategy]), F.col("raw_text"))
            added[column_of(rule)] = _udf(rule, rule.score(config))(gated, F.col("fm.kv"), F.col("body_start"))
        elif rule.strategy == "entropy_check":
            values = entropy_values(rule)
            added[column_of(rule)] = _dense(float(rule.match.get("min_entropy", 4.5)))(F.when(F.size(values) > 0, values))
        elif rule.strategy == "ip_address_scan" and "ipv6" not in added:
            added["ipv6"] = ipv6_of(F.array_distinct(F.transform(F.regexp_extract_all("raw_text", F.lit(net.BRACKETED), F.lit(1)), F.lower)))
    return parsed.withColumns(added) if added else parsed

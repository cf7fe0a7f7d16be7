"""Operators over the lines of a document.  Each gives a column of signals; all of it is JVM-side array work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden import terms
from docwarden.config import Config
from docwarden.functions import net
from docwarden.functions.text import any_of, first_of, has_words, let, preview, strings
from docwarden.model import SIGNAL
from docwarden.rulepack import Rule

NONE = "array<" + SIGNAL + ">"
_ENV_REF = r"(?i)(?:os\.getenv\(|\{\{\s*secrets\.[^}]+\}\}|\$\{[A-Z0-9_]+\}|\$[A-Z_][A-Z0-9_]*)"
_PLACEHOLDER = r"(?i)(?:<\s*placeholder\s*>|\b(?:changeme|todo|xxx+)\b|\b(?:replace|your)[-_])"
_TOOL_TOKEN = r"\b[A-Z][A-Z0-9_]{3,}\b"
_MAY_BE_ADDRESS = r"\d\.\d|\[[0-9A-Fa-f:]+\]"
_SERVICE_TOKEN = r"[A-Z][A-Z0-9]+(?:_[A-Z0-9]+){2,}"


def signal(score: Column | int, confidence: Column | str, description: Column | str, line: Column | int, snippet: Column) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        column(score).cast("int").alias("score"), column(confidence).alias("confidence"), column(description).alias("description"),
        column(line).cast("int").alias("line"), snippet.alias("snippet"),
    )


def no_signals() -> Column:
    return F.array().cast(NONE)


def one(found: Column, item: Column) -> Column:
    """The signal if something was found."""
    return F.when(found, F.array(item)).otherwise(no_signals())


def filled(template: str, **values: Column) -> Column:
    """Template with {name} replaced; other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _front_matter_entries() -> Column:
    return F.coalesce(F.col("fm.kv"), F.array().cast("array<struct<key:string,value:string,line:int>>"))


def url_domain_filter(rule: Rule, config: Config) -> Column:
    """URLs of each line whose host the rule's check reports."""
    match, score, meta = rule.match, rule.score(config), rule.metadata
    sources = match.get("field_source_filter")

    def accepted(url: Column, host: Column) -> Column:
        kind = match.get("url_filter", "any_url")
        if kind == "is_mcp_endpoint":
            return net.is_mcp_path(url)
        return ~net.is_address(host) if kind == "skip_ip_addresses" else F.lit(True)

    check = match["domain_check"]
    denied = lambda host: net.is_denied(host, config.denylist_domains)
    place = "Documentation" if check == "not_allowlisted_prose" else "Configuration"

    def reported(host: Column) -> Column:
        if check == "is_denylisted":
            return net.is_denied(host, config.mcp_denylist_domains)
        if check == "not_mcp_allowlisted":
            return ~net.in_domains(host, config.mcp_allowlist_domains, strict=config.strict_subdomains)
        outside = denied(host) | ~net.in_domains(host, config.allowed_domains, strict=config.strict_subdomains)
        return outside & ~net.is_local_host(host) if config.suppress_local_hosts else outside

    def report(hit: Column, f: Column) -> Column:
        if check in ("is_denylisted", "not_mcp_allowlisted"):
            return signal(score, meta["confidence"], filled(rule.template, url=hit["url"], domain=hit["host"]), f["line"], f["snippet"])
        plain = (15, "low") if place == "Documentation" else (55, "medium") if config.allowlist_domains else (35, "low")
        bad = denied(hit["host"])
        text = F.when(bad, F.concat(F.lit(f"{place} references '"), hit["host"], F.lit("', which is denylisted."))).otherwise(F.concat(F.lit(f"{place} references external domain '"), hit["host"], F.lit("'.")))
        return signal(F.when(bad, 80).otherwise(plain[0]), F.when(bad, "high").otherwise(plain[1]), text, f["line"], f["snippet"])

    mapped = match.get("score_map") or {}

    def scored(s: Column) -> Column:
        """The signal with the score of the last entry of the map that the check's result names."""
        score = s["score"]
        for name, value in mapped.items():
            if check in ("is_denylisted", "not_mcp_allowlisted"):
                score = F.lit(int(value)) if name in "True" else score
            else:
                result = F.concat(F.lit("{'score': "), s["score"].cast("string"), F.lit(", 'description': '"), s["description"], F.lit("', 'confidence': '"), s["confidence"], F.lit("'}"))
                score = F.when(F.contains(result, F.lit(name)), int(value)).otherwise(score)
        return signal(score, s["confidence"], s["description"], s["line"], s["snippet"])

    def of_line(f: Column) -> Column:
        urls = F.transform(net.urls_in(f["value"]), net.clean_url)
        hits = F.transform(urls, lambda u: F.struct(u.alias("url"), net.host_of(u).alias("host")))
        wanted = F.filter(hits, lambda h: (h["host"] != "") & accepted(h["url"], h["host"]) & reported(h["host"]))
        found = F.transform(wanted, lambda h: report(h, f))
        return F.transform(found, scored) if mapped else found

    lines = F.filter(F.col("fields"), lambda f: (f["field_source"].isin(*sources) if sources else F.lit(True)) & F.contains(F.lower(f["value"]), F.lit("://")))
    return F.when(F.contains("raw_text", F.lit("://")), F.flatten(F.transform(lines, of_line))).otherwise(no_signals())


def ip_address_scan(rule: Rule, config: Config) -> Column:
    """The first address of each line; needs the column ``ipv6`` (see :mod:`docwarden.operators.python`)."""
    base = rule.score(config)
    public, closed = rule.match.get("score_public", base), rule.match.get("score_non_public", base)

    def addresses(value: Column) -> Column:
        hosts = F.transform(net.urls_in(value), net.host_of)
        plain = F.regexp_extract_all(value, F.lit(net.IPV4_LIKE), F.lit(0))
        bracketed = F.regexp_extract_all(value, F.lit(net.BRACKETED), F.lit(1))
        return F.filter(F.concat(hosts, plain, F.transform(bracketed, F.lower)), lambda a: net.is_ipv4(a) | F.element_at(F.col("ipv6"), a).isNotNull())

    def of_line(f: Column) -> Column:
        first = F.slice(addresses(f["value"]), 1, 1)

        def report(a: Column) -> Column:
            six = F.element_at(F.col("ipv6"), a)
            text = F.coalesce(six["text"], a)
            hidden = F.coalesce(six["closed"], net.is_private_ipv4(a))
            words = F.when(hidden, F.concat(F.lit("Configuration references a non-public raw IP address ("), text, F.lit(").")))
            words = words.otherwise(F.concat(F.lit("Configuration references a public raw IP address ("), text, F.lit("), bypassing domain controls.")))
            return signal(F.when(hidden, closed).otherwise(public), "high", words, f["line"], f["snippet"])

        return F.transform(first, report)

    lines = F.filter(F.col("fields"), lambda f: f["value"].rlike(_MAY_BE_ADDRESS))
    return F.when(F.col("raw_text").rlike(_MAY_BE_ADDRESS), F.flatten(F.transform(lines, of_line))).otherwise(no_signals())


def column_of(rule: Rule) -> str:
    """Column with what :func:`docwarden.operators.python.with_python` finds for a rule."""
    return f"__signals_{rule.rule_id}"


def _may_be_opaque(rule: Rule, value: Column, length: int) -> Column:
    """Whether a value is long enough, and no prose."""
    long = F.length(value) >= length
    if rule.match.get("skip_prose"):
        long = long & ~(F.contains(value, F.lit(" ")) & has_words(value, int(rule.match.get("prose_min_words", 3))))
    return long


def entropy_values(rule: Rule) -> Column:
    """The values whose entropy :func:`entropy_check` needs."""
    least = rule.match.get("min_length", 80)
    values = F.filter(F.transform(F.col("fields"), lambda f: f["value"]), lambda v: _may_be_opaque(rule, v, least))
    if rule.match.get("scan_frontmatter"):
        declared = F.transform(_front_matter_entries(), lambda e: F.trim(e["value"]))
        values = F.concat(values, F.filter(declared, lambda v: _may_be_opaque(rule, v, rule.match.get("frontmatter_min_length", least))))
    return F.array_distinct(values)


def entropy_check(rule: Rule, config: Config) -> Column:
    """Long lines and front matter values that look encoded; prose is left alone.

    One Arrow UDF tells which values are dense, for a batch of documents.
    """
    match, score, meta = rule.match, rule.score(config), rule.metadata
    least = match.get("min_length", 80)

    def opaque(value: Column, length: int) -> Column:
        dense = F.coalesce(F.array_contains(F.col(f"`{column_of(rule)}`"), value), F.lit(False))
        encoded = value.rlike(match["base64_pattern"]) if match.get("base64_pattern") else F.lit(False)
        return F.when(_may_be_opaque(rule, value, length), encoded | dense).otherwise(F.lit(False))

    lines = F.transform(F.filter(F.col("fields"), lambda f: opaque(f["value"], least)), lambda f: signal(score, meta["confidence"], rule.description, f["line"], f["snippet"]))
    if not match.get("scan_frontmatter"):
        return lines
    values = F.transform(_front_matter_entries(), lambda e: F.struct(e["key"].alias("key"), F.trim(e["value"]).alias("value"), e["line"].alias("line")))
    found = F.filter(values, lambda e: opaque(e["value"], match.get("frontmatter_min_length", least)))
    text = lambda e: F.concat(F.lit("Frontmatter key '"), e["key"], F.lit("' contains an opaque or encoded blob."))
    return F.concat(lines, F.transform(found, lambda e: signal(score, meta["confidence"], text(e), e["line"], F.substring(e["value"], 1, 120))))


def key_pattern_match(rule: Rule, config: Config) -> Column:
    """Keys of lines and of the front matter that are, or hold, one of the words."""
    match, score, meta = rule.match, rule.score(config), rule.metadata
    words = match.get("keywords", [])
    mode = match.get("match_mode", "contains")
    if not words:
        return no_signals()

    def named(f: Column) -> Column:
        key = F.lower(f["key"])
        found = key.isin(*words) if mode == "exact" else key.rlike(any_of(words))
        if match.get("skip_placeholder_values"):
            where = F.lit(True) if match.get("skip_placeholder_values_anywhere") else f["in_code_block"]
            found = found & ~(where & f["value"].rlike(_PLACEHOLDER))
        return F.coalesce(found, F.lit(False))

    lines = F.transform(F.filter(F.col("fields"), lambda f: f["key"].isNotNull() & named(f)), lambda f: signal(score, meta["confidence"], filled(rule.template, key=f["key"]), f["line"], f["snippet"]))
    # a key stands before a colon
    lines = F.when(F.contains("raw_text", F.lit(":")), lines).otherwise(no_signals())
    if not match.get("scan_frontmatter"):
        return lines
    skipped = strings(match.get("frontmatter_skip_keys", terms.FRONT_MATTER_SKIP))
    wanted = strings(words)

    def tokens(segment: Column) -> Column:
        parts = F.filter(F.split(F.lower(F.regexp_replace(segment, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda t: t != "")
        pairs = F.when(F.size(parts) > 1, F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: F.concat(a, b)))
        return F.concat(parts, F.coalesce(pairs, F.array().cast("array<string>")))

    def declared(e: Column) -> Column:
        segments = F.split(e["key"], r"\.")
        low = F.transform(segments, F.lower)
        hit = F.arrays_overlap(low, wanted) if match.get("frontmatter_match_mode", mode) == "exact" else F.exists(segments, lambda s: F.arrays_overlap(tokens(s), wanted))
        return hit & ~F.arrays_overlap(low, skipped)

    snippet = lambda e: F.concat(e["key"], F.lit(": "), F.substring(e["value"], 1, 80))
    return F.concat(lines, F.transform(F.filter(_front_matter_entries(), declared), lambda e: signal(score, meta["confidence"], filled(rule.template, key=e["key"]), e["line"], snippet(e))))


def field_pattern_match(rule: Rule, config: Config) -> Column:
    """Lines in which a pattern is found."""

    def found(f: Column) -> Column:
        hit = f["value"].rlike("(?i)" + rule.match["pattern"])
        if rule.match.get("exclude_pattern_fn") == "is_non_secret_env_ref":
            refs = F.transform(F.regexp_extract_all(f["value"], F.lit(_ENV_REF), F.lit(0)), F.lower)
            hit = hit & F.exists(refs, lambda r: r.rlike(any_of(terms.SECRET_REF_WORDS)))
        return hit

    signals = F.transform(F.filter(F.col("fields"), found), lambda f: signal(rule.score(config), rule.metadata["confidence"], rule.description, f["line"], f["snippet"]))
    if rule.match.get("exclude_pattern_fn") != "is_non_secret_env_ref":
        return signals
    # what every reference holds, over the whole text first
    return F.when(F.col("raw_text").rlike(r"(?i)\$|\{\{|os\.getenv\("), signals).otherwise(no_signals())


def token_scan(rule: Rule, config: Config) -> Column:
    """One signal for all tool tokens of a document, weighed by what their names say they do."""
    match = rule.match
    prefixes = config.tool_prefixes if match.get("prefix_source", "config.tool_prefixes") == "config.tool_prefixes" else tuple(str(p).upper() for p in match.get("prefixes", []))
    services = match.get("service_prefixes", terms.SERVICE_PREFIXES)
    by_service = bool(match.get("scan_service_tokens"))
    if not prefixes and not by_service:
        return no_signals()

    def is_tool(token: Column) -> Column:
        found = token.rlike(f"^{any_of(prefixes)}") if prefixes else F.lit(False)
        if by_service:
            full = (F.length(token) >= int(match.get("service_min_total_length", 15))) & token.rlike(f"^{match.get('service_token_pattern', _SERVICE_TOKEN)}$")
            segments = F.split(token, "_")
            full = full & (F.size(segments) >= int(match.get("service_min_segments", 3)))
            found = found | (full & F.element_at(segments, 1).isin(*[str(s).strip().upper() for s in services]) if services else full)
        return found

    def of_line(f: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(f["value"], F.lit(match.get("token_pattern", _TOOL_TOKEN)), F.lit(0)), is_tool)
        return F.struct(f["line"].alias("line"), tokens.alias("tokens"))

    lines = F.filter(F.transform(F.filter(F.col("fields"), lambda f: f["value"].rlike("[A-Z][A-Z0-9_]{3}")), of_line), lambda x: F.size(x["tokens"]) > 0)
    # counted in a struct, so that the tokens are found once
    found = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.transform(x, lambda y: y["tokens"])))).alias("tokens")))

    def report(x: Column) -> Column:
        tokens, n = x["tokens"], F.size(x["tokens"])
        has = lambda t, words: F.arrays_overlap(F.split(t, "_"), strings(words))
        destructive = F.size(F.filter(tokens, lambda t: has(t, config.destructive)))
        write = F.size(F.filter(tokens, lambda t: has(t, config.write) & ~has(t, config.destructive)))
        score = F.least(F.lit(50), F.lit(rule.score(config)) + F.least(n, F.lit(10)) * 2 + destructive * 15 + write * 8)
        tiers = F.concat_ws(", ", *[F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {name}"))) for name, c in (("destructive", destructive), ("write", write), ("read", n - destructive - write))])
        text = F.concat(F.lit("Skill references "), n.cast("string"), F.lit(" tool invocation token"), F.when(n == 1, "").otherwise("s"), F.lit(". Tiers: "), tiers, F.lit("."))
        return signal(score, rule.metadata["confidence"], text, F.element_at(x["lines"], 1)["line"], preview(tokens, 5, ", "))

    # the pattern of lines, over the whole text first
    return F.when(F.col("raw_text").rlike("[A-Z][A-Z0-9_]{3}"), F.transform(F.filter(found, lambda x: F.size(x["tokens"]) > 0), report)).otherwise(no_signals())


def data_sensitivity_check(rule: Rule, config: Config) -> Column:
    """One signal if the lines name a service or words that stand for sensitive data."""
    match, sense = rule.match, config.sensitivity
    categories = terms.SERVICE_CATEGORIES | sense.categories
    shown = int(match.get("max_keyword_preview", 5))
    line_type = "array<struct<term:string,line:int,snippet:string>>"
    lines = F.transform(F.col("fields"), lambda f: F.struct(F.lower(f["value"]).alias("low"), f["line"].alias("line"), f["snippet"].alias("snippet")))

    def hits(low_lines: Column, present: Column, words: tuple[str, ...]) -> Column:
        """The words that occur, in the order given, each with its first line."""
        if not words:
            return F.array().cast(line_type)
        mine = F.filter(strings(tuple(dict.fromkeys(words))), lambda w: F.array_contains(present, w))
        bounded = lambda low, w: F.contains(low, w) & F.rlike(low, F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E\b")))
        first = F.transform(mine, lambda w: F.struct(w.alias("term"), F.get(F.filter(low_lines, lambda x: bounded(x["low"], w)), F.lit(0)).alias("at")))
        return F.transform(F.filter(first, lambda x: x["at"].isNotNull()), lambda x: F.struct(x["term"].alias("term"), x["at"]["line"].alias("line"), x["at"]["snippet"].alias("snippet")))

    vocabulary = sorted({*sum(sense.services.values(), ()), *sum(sense.keywords.values(), ())})
    if not vocabulary:
        return no_signals()
    present = let(F.lower(F.col("raw_text")), lambda low: F.filter(strings(vocabulary), lambda w: F.contains(low, w)))
    # lines are looked at only in documents that hold a term somewhere
    stages = F.filter(F.array(present), lambda p: F.size(p) > 0)
    found = F.transform(
        stages,
        lambda p: let(
            F.filter(lines, lambda x: F.exists(p, lambda w: F.contains(x["low"], w))),
            lambda x: F.struct(*[F.slice(hits(x, p, sense.services[t]), 1, 1).alias(t) for t in ("high", "medium", "low")], *[hits(x, p, sense.keywords[t]).alias(f"{t}_words") for t in ("high", "medium")]),
        ),
    )

    def report(x: Column) -> Column:
        high_words, medium_words = x["high_words"], x["medium_words"]
        strong = F.filter(medium_words, lambda w: ~w["term"].isin(*terms.WEAK_KEYWORDS))
        context = (F.size(high_words) > 0) | (F.size(strong) > 0)
        use_medium = context if match.get("require_keywords_for_medium_service", True) else F.lit(True)
        tier = F.when(F.size(x["high"]) > 0, "high").when(F.size(x["medium"]) > 0, F.when(use_medium, "medium")).when(F.size(x["low"]) > 0, "low")
        service = F.when(tier == "high", F.get(x["high"], F.lit(0))).when(tier == "medium", F.get(x["medium"], F.lit(0))).when(tier == "low", F.get(x["low"], F.lit(0)))
        words_tier = F.when(F.size(high_words) > 0, "high").when(F.size(strong) >= max(1, int(match.get("min_medium_keyword_hits", 1))), "medium")
        level = F.coalesce(tier, words_tier)
        score = F.when(level == "high", terms.TIER_SCORES["high"]).when(level == "medium", terms.TIER_SCORES["medium"]).otherwise(terms.TIER_SCORES["low"])
        score = F.least(F.lit(100), score + F.when(F.size(high_words) > 0, 10).otherwise(0))
        table = F.create_map(*[F.lit(v) for pair in categories.items() for v in pair])
        kinds = F.create_map(*[F.lit(v) for pair in terms.KEYWORD_CATEGORIES.items() for v in pair])
        first_kind = F.filter(F.transform(F.when(F.size(high_words) > 0, high_words).otherwise(medium_words), lambda w: F.element_at(kinds, w["term"])), lambda c: c.isNotNull())
        by_service = F.element_at(table, service["term"])
        by_words = F.when((F.size(high_words) > 0) | (F.size(medium_words) > 0), first_of(first_kind, F.lit("sensitive-data")))
        category = F.coalesce(by_service, by_words, F.lit("unknown"))
        origin = F.when(by_service.isNotNull(), "service").otherwise("keyword")
        sources = F.concat_ws("+", F.when(service.isNotNull(), "service_text"), F.when(F.size(high_words) > 0, "keyword_high"), F.when(F.size(strong) > 0, "keyword_medium"))
        named = lambda label, w: F.when(F.size(w) > 0, F.concat(F.lit(f"{label}-sensitivity keywords: "), F.array_join(F.slice(F.transform(w, lambda y: y["term"]), 1, shown), ", "), F.lit(".")))
        head = F.when(service.isNotNull(), F.concat(F.lit("Skill text references service '"), service["term"], F.lit("' ("), tier, F.lit("-sensitivity service).")))
        head = head.otherwise(F.concat(F.lit("Skill text contains "), level, F.lit("-sensitivity data keywords.")))
        text = F.concat_ws(" ", head, F.concat(F.lit("Category: "), category, F.lit(" (category_source="), origin, F.lit(").")), F.concat(F.lit("signal_source="), sources, F.lit(".")), named("High", high_words), named("Medium", medium_words))
        place = F.coalesce(service, F.get(high_words, F.lit(0)), F.get(strong, F.lit(0)))
        return F.when(level.isNotNull() & (sources != ""), signal(score, rule.metadata["confidence"], text, place["line"], place["snippet"]))

    return F.filter(F.transform(found, report), lambda s: s.isNotNull())


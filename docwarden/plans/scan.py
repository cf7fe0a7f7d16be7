"""From documents to findings.

Rules of one document become array columns of one projection over the parsed
documents; duplicates and covered signals leave the arrays before they are
exploded.  So a scan of any size is one pass without a shuffle.  What looks
across documents (:mod:`docwarden.plans.across`) is joined by union.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden import terms
from docwarden.config import Config, Override
from docwarden.functions.names import finding_id
from docwarden.functions.text import let
from docwarden.model import OVERRIDE
from docwarden.operators import LOCAL
from docwarden.operators.python import with_python
from docwarden.plans.parse import parse
from docwarden.rulepack import Rule, find_rule

_NET = ("NET_DOC_DOMAIN", "NET_UNKNOWN_DOMAIN")
#: (covering rule, rules that it covers on the same line, whether only signals of at most its score)
SUPPRESSION = (
    ("MCP_ENDPOINT", _NET, True),
    ("REMOTE_REFERENCE_RISK", _NET, False),
    ("UNICODE_BIDI_CONTROL", ("HIDDEN_INSTRUCTION",), False),
    ("CONFUSABLE_IDENTIFIER_EXTENDED", ("HIDDEN_INSTRUCTION",), False),
    ("INSTR_OBFUSCATED_PAYLOAD", ("OPAQUE_BLOB",), False),
)
CANDIDATE_COLUMNS = ("skill", "rule_id", "internal_rule_id", "score", "confidence", "title", "description", "path", "line", "snippet", "recommendation", "classification")


def stamped(rule: Rule, signals: Column) -> Column:
    """Candidates: signals with what the rule says; the first of equal ones if the rule asks for that."""
    found = F.array_distinct(signals) if rule.dedupe else signals
    return F.transform(
        found,
        lambda s: F.struct(
            F.lit(rule.public_id).alias("rule_id"), F.lit(rule.rule_id).alias("internal_rule_id"), s["score"].alias("score"), s["confidence"].alias("confidence"),
            F.lit(rule.metadata["title"]).alias("title"), s["description"].alias("description"), s["line"].alias("line"), s["snippet"].alias("snippet"),
            F.lit(rule.metadata["recommendation"]).alias("recommendation"), F.lit(rule.classification).alias("classification"),
        ),
    )


def uncovered(candidates: Column) -> Column:
    """The candidates of one document that no other one on their line covers."""

    def keep(candidates: Column, c: Column) -> Column:
        covered = F.lit(False)
        for cover, ids, by_score in SUPPRESSION:
            covering = F.exists(candidates, lambda m: (m["rule_id"] == cover) & m["line"].eqNullSafe(c["line"]) & ((c["score"] <= m["score"]) if by_score else F.lit(True)))
            covered = covered | (c["rule_id"].isin(*ids) & covering)
        return ~covered

    return let(candidates, lambda all_of: F.filter(all_of, lambda c: keep(all_of, c)))


def local_candidates(docs: DataFrame, rules: Sequence[Rule], config: Config, *, front_matter: bool = False, suppress: bool = True) -> DataFrame:
    """Candidates of the rules that look at one document; docs has path, skill and raw_text.

    Documents that can't be read have none.
    """
    chosen = [r for r in rules if r.strategy in LOCAL]
    known = docs if "fields" in docs.columns else parse(docs, front_matter=front_matter)
    ready = with_python(known.filter("parse_error is null"), chosen, config)
    arrays = {f"c{i}": stamped(rule, LOCAL[rule.strategy](rule, config)) for i, rule in enumerate(chosen)}
    if not arrays:
        return ready.limit(0).select("skill", *[F.lit(None).cast("int" if c in ("score", "line") else "string").alias(c) for c in CANDIDATE_COLUMNS[1:]])
    wide = ready.select("path", "skill", *[c.alias(n) for n, c in arrays.items()])
    all_of = wide.select("path", "skill", F.concat(*arrays).alias("c"))
    # explode() would add a filter on the array's size, for which Spark computes the whole array a second time
    left = all_of.select("path", "skill", F.explode_outer(uncovered(F.col("c")) if suppress else F.col("c")).alias("c")).filter("c is not null")
    return left.select("skill", "path", "c.*").select(*CANDIDATE_COLUMNS)


def run_rule(docs: DataFrame, rules: Sequence[Rule], rule_id: str, config: Config | None = None, *, front_matter: bool = True) -> DataFrame:
    """Candidates of one rule that looks at one document, by its internal id or by a public one that a single rule has."""
    return local_candidates(docs, [find_rule(rules, rule_id)], config or Config(), front_matter=front_matter, suppress=False)


def suppress_rows(candidates: DataFrame) -> DataFrame:
    """The same for a table of candidates (path, rule_id, line, score): one anti join for all pairs of rules."""
    pairs = [(cover, covered, by_score) for cover, ids, by_score in SUPPRESSION for covered in ids]
    table = candidates.sparkSession.createDataFrame(pairs, "cover string, covered string, by_score boolean")
    covers = candidates.join(F.broadcast(table), candidates["rule_id"] == table["cover"]).groupBy(F.col("path").alias("m_path"), F.col("line").alias("m_line"), "covered", "by_score").agg(F.max("score").alias("m_score"))
    on = (F.col("path") == F.col("m_path")) & F.col("line").eqNullSafe(F.col("m_line")) & (F.col("rule_id") == F.col("covered")) & (~F.col("by_score") | (F.col("score") <= F.col("m_score")))
    return candidates.join(covers, on, "left_anti")


def first_rows(candidates: DataFrame, order: str) -> DataFrame:
    """First candidate of each (rule_id, path, line, description), by a column of order; ties by the other columns."""
    keys = ["rule_id", "path", "line", "description"]
    rest = F.struct(*[c for c in candidates.columns if c not in keys])
    first = candidates.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("by"), rest.alias("rest"))).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col("__first.rest")[c].alias(c) for c in candidates.columns])


def severity(score: Column, config: Config) -> Column:
    return F.when(score >= config.high_from, "high").when(score >= config.medium_from, "medium").otherwise("low")


def _overridden(score: Column, override: Override, config: Config) -> tuple[Column, Column]:
    """Score and severity after a policy's bounds: raised first, then capped."""
    level = severity(score, config)
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    if override.min_severity:
        least = {"low": 0, "medium": config.medium_from, "high": config.high_from}[override.min_severity]
        low = rank(level) < terms.SEVERITY_RANK[override.min_severity]
        score, level = F.when(low, F.greatest(score, F.lit(least))).otherwise(score), F.when(low, F.lit(override.min_severity)).otherwise(level)
    if override.max_severity:
        most = {"low": config.medium_from - 1, "medium": config.high_from - 1, "high": 100}[override.max_severity]
        high = rank(level) > terms.SEVERITY_RANK[override.max_severity]
        score, level = F.when(high, F.least(score, F.lit(max(0, most)))).otherwise(score), F.when(high, F.lit(override.max_severity)).otherwise(level)
    return score, level


def to_findings(candidates: DataFrame, config: Config) -> DataFrame:
    """Findings with their stable id, clamped score, severity and what a policy changed of it."""
    plain = F.greatest(F.lit(0), F.least(F.lit(100), F.col("score")))
    score, level = plain, severity(plain, config)
    for rule_id, override in sorted(config.overrides.items()):
        if override.min_severity or override.max_severity:
            new_score, new_level = _overridden(plain, override, config)
            mine = F.col("rule_id") == rule_id
            score, level = F.when(mine, new_score).otherwise(score), F.when(mine, new_level).otherwise(level)
    scored = candidates.withColumns({"__plain": plain, "__score": score.cast("int"), "__level": level})
    changed = (F.col("__score") != F.col("__plain")) | (F.col("__level") != severity(F.col("__plain"), config))
    return scored.select(
        finding_id(*map(F.col, ("skill", "rule_id", "title", "description", "path", "line", "snippet"))).alias("id"),
        F.col("__level").alias("severity"), F.col("__score").alias("score"), "confidence", "title", "description",
        F.struct("path", "line", "snippet").alias("evidence"), "skill", "rule_id", "recommendation", "classification",
        F.when(changed, F.struct(severity(F.col("__plain"), config).alias("original"), F.col("__level").alias("applied"), F.lit("rule_override").alias("reason"))).cast(OVERRIDE).alias("severity_override"),
    )


def scan(docs: DataFrame, rules: Sequence[Rule], config: Config | None = None, *, front_matter: bool = False, more: Iterable[DataFrame] = ()) -> DataFrame:
    """Findings of documents (path, skill, raw_text); ``more`` holds candidates from elsewhere."""
    config = config or Config()
    candidates = local_candidates(docs, rules, config, front_matter=front_matter)
    return to_findings(reduce(DataFrame.unionByName, [c.select(*CANDIDATE_COLUMNS) for c in more], candidates), config)


"""Aggregates of findings: scores, counts, top risks, domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.config import Config
from docwarden.functions import net
from docwarden.plans.scan import severity

_DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\b"
#: rule -> key of the configuration that allows its domains
ALLOWED_BY = {"NET_DOC_DOMAIN": "allowlist_domains", "MCP_ENDPOINT": "mcp_allowlist_domains"}
HINT_FINDINGS, HINT_SHARE = 3, 0.5


def combined(scores: Column) -> Column:
    """100 * (1 - product of (1 - s / 100)), halves to even; sorted, so that it doesn't depend on the order."""
    rest = F.aggregate(F.array_sort(scores), F.lit(1.0), lambda a, s: a * (F.lit(1.0) - s / F.lit(100.0)))
    return F.rint((F.lit(1.0) - rest) * 100).cast("int")


def overall_scores(findings: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """overall_score of each group of keys: the greatest score of each rule, of those at least ``least``.

    Without keys there is one row, with 0 where there are no findings.
    """
    per_rule = findings.groupBy(*keys, "rule_id").agg(F.max("score").alias("score"))
    return per_rule.groupBy(*keys).agg(combined(F.collect_list(F.when(F.col("score") >= least, F.col("score")))).alias("overall_score"))


def severity_counts() -> Column:
    return F.create_map(*[x for level in ("high", "medium", "low") for x in (F.lit(level), F.count_if(F.col("severity") == level).cast("int"))])


def count_by_rule(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """counts_by_rule: map from rule to number, in order of the rules."""
    counts = findings.groupBy(*keys, "rule_id").agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("counts_by_rule"))


def top_risks(findings: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Rows of the n findings of greatest score of each group, with their rank; ties by id."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return findings.withColumn("rank", rank).filter(F.col("rank") <= n)


def summaries(findings: DataFrame, config: Config, keys: Sequence[str] = ("skill",)) -> DataFrame:
    """One row per group: overall_score, overall_severity, finding_count, counts_by_severity, counts_by_rule, top_risks.

    One shuffle of partial aggregates per rule, one of the result: rules are few,
    and a group holds at most five risks of each rule.
    """
    risk = F.struct(F.negate("score").alias("minus"), "id", "rule_id", "title", "severity", "score", "evidence")
    ranked = findings.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "rule_id").orderBy(F.desc("score"), "id")))
    per_rule = ranked.groupBy(*keys, "rule_id").agg(
        F.max("score").alias("best"), F.count("*").cast("int").alias("n"),
        *[F.count_if(F.col("severity") == s).cast("int").alias(s) for s in ("high", "medium", "low")],
        F.collect_list(F.when(F.col("__place") <= 5, risk)).alias("risks"),
    )
    whole = per_rule.groupBy(*keys).agg(
        combined(F.collect_list(F.when(F.col("best") >= config.least_rule_score, F.col("best")))).alias("overall_score"),
        F.sum("n").cast("int").alias("finding_count"),
        F.create_map(*[x for s in ("high", "medium", "low") for x in (F.lit(s), F.sum(s).cast("int"))]).alias("counts_by_severity"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("counts_by_rule"),
        F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("risks"))), 1, 5), lambda r: r.dropFields("minus")).alias("top_risks"),
    )
    return whole.withColumn("overall_severity", severity(F.col("overall_score"), config))


def workspace(findings: DataFrame, config: Config) -> DataFrame:
    """One row for all findings: aggregate_score, aggregate_severity, total and counts; zeros if there are none."""
    per_rule = findings.groupBy("rule_id").agg(F.max("score").alias("best"), F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    whole = per_rule.agg(
        combined(F.collect_list(F.when(F.col("best") >= config.least_rule_score, F.col("best")))).alias("aggregate_score"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("high", "medium", "low")],
    )
    return whole.withColumn("aggregate_severity", severity(F.col("aggregate_score"), config))


def passing(findings: DataFrame, *, min_severity: str | None = None, security_only: bool = False) -> DataFrame:
    """Findings of at least a severity, of security alone if asked for."""
    if min_severity:
        findings = findings.filter(F.col("severity").isin(*{"low": ["low", "medium", "high"], "medium": ["medium", "high"], "high": ["high"]}[min_severity]))
    return findings.filter("classification = 'security'") if security_only else findings


def filtered_reasons(findings: DataFrame, *, min_severity: str | None = None, security_only: bool = False) -> DataFrame:
    """One row: shown, total, below_severity and informational; what is below counts there alone."""
    levels = {"low": 0, "medium": 1, "high": 2}
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    below = (rank < levels[min_severity]) if min_severity else F.lit(False)
    info = ~below & (F.col("classification") != "security") if security_only else F.lit(False)
    return findings.agg(F.count_if(~below & ~info).alias("shown"), F.count("*").alias("total"), F.count_if(below).alias("below_severity"), F.count_if(info).alias("informational"))


def gate_fails(findings: DataFrame, aggregate_score: int, *, fail_on: str | None = None, fail_on_score: int | None = None) -> bool:
    """Whether a threshold of CI is reached, by all findings."""
    if fail_on_score is not None and aggregate_score >= fail_on_score:
        return True
    return fail_on is not None and not passing(findings, min_severity=fail_on).isEmpty()


def domain_of(rule_id: Column, description: Column, snippet: Column) -> Column:
    """Domain that a finding is about: of a URL in its texts, of a quoted value, or a bare one."""
    of_url = lambda text: F.get(F.filter(F.transform(net.urls_in(text), net.host_of), lambda h: h != ""), F.lit(0))
    clean = lambda q: F.regexp_replace(F.lower(F.trim(q)), r"[.,;:!?)]+$", "")
    valid = lambda q: F.when(net.host_of(clean(q)) != "", net.host_of(clean(q))).when(clean(q).rlike(f"^(?:{_DOMAIN})$"), clean(q))
    quoted = F.filter(F.transform(F.regexp_extract_all(description, F.lit("'([^']+)'"), F.lit(1)), valid), lambda d: d.isNotNull())
    bare = lambda text: F.when(text.rlike(_DOMAIN), F.lower(F.regexp_extract(text, _DOMAIN, 0)))
    return F.coalesce(of_url(snippet), of_url(description), F.when(rule_id == "NET_DOC_DOMAIN", F.get(quoted, F.lit(0))), bare(snippet), bare(description))


def domain_counts(findings: DataFrame) -> DataFrame:
    """Rows (rule_id, domain, n, total) of the rules whose domains can be allowed; total counts the rule's findings."""
    mine = findings.filter(F.col("rule_id").isin(*ALLOWED_BY)).select("rule_id", domain_of(F.col("rule_id"), F.col("description"), F.col("evidence.snippet")).alias("domain"))
    counts = mine.groupBy("rule_id", "domain").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("rule_id"))).filter("domain is not null")


def dominant_domains(findings: DataFrame) -> DataFrame:
    """Rules of which one domain makes more than half of three findings or more."""
    top = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("n"), "domain"))
    counts = domain_counts(findings).withColumn("place", top).filter("place = 1")
    return counts.filter((F.col("total") >= HINT_FINDINGS) & (F.col("n") / F.col("total") > HINT_SHARE)).select("rule_id", "domain", "n", "total")

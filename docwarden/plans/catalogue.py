"""Queries that the driver runs over whole tables, with equivalent DuckDB SQL.

Texts that hold what the rules look for are composed of table columns where the
tables have none (:func:`cards`); the SQL composes the same texts and then finds
lines, keys, hosts and findings by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden import rulepack, terms
from docwarden.config import Config, Override, Sensitivity
from docwarden.plans import across, score
from docwarden.plans.parse import parse
from docwarden.plans.scan import first_rows, local_candidates, scan, suppress_rows, to_findings
from docwarden.rulepack import Rule
from docwarden.sources import tables
from docwarden.streaming.scan import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rules(*ids: str) -> list[Rule]:
    return [r for r in rulepack.load() if not ids or r.rule_id in ids]


def _changed(rule_id: str, **match) -> list[Rule]:
    """A bundled rule with other parameters."""
    (rule,) = _rules(rule_id)
    return [replace(rule, match=rule.match | match)]


def told(findings: DataFrame) -> DataFrame:
    """Findings as scalars that any engine has."""
    return findings.select(
        "id", "skill", "rule_id", "severity", F.col("score").cast("long").alias("score"), "description",
        F.col("evidence.path").alias("path"), F.col("evidence.line").cast("long").alias("line"), F.col("evidence.snippet").alias("snippet"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small configuration document for each customer."""
    key = F.col("c_custkey")
    segment = F.lower(F.col("c_mktsegment"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("owner: "), F.col("c_name")),
        F.concat(F.lit("See https://"), segment, F.lit(".example.io/"), F.when(key % 3 == 0, "mcp").otherwise("about"), F.lit(".")),
        F.lit(""),
        F.lit("```"),
        F.concat(F.lit("  token: ${TOKEN_"), key, F.lit("}")),
        F.concat(F.lit("run: job "), key),
        F.concat(F.lit("fetch https://files"), key % 7, F.lit(".example.net/x")),
        F.lit("```"),
        F.concat(F.lit("Password: "), F.when(key % 2 == 0, "changeme").otherwise(F.concat(F.lit("hunter"), key))),
        F.concat(F.lit("at 10.0."), key % 256, F.lit(".7 or http://203.0.114."), key % 256, F.lit("/in")),
        F.concat(F.lit("Bill the "), segment, F.lit(" account with "), F.when(key % 5 == 0, "stripe").when(key % 5 == 1, "slack").otherwise("post"), F.when(key % 4 == 0, " and a payment").otherwise("")),
    )
    rows = tables.spread(tables.read(spark, sf_dir, "customer"), "c_custkey")
    return tables.as_documents(rows, F.concat(F.lit("card-"), key), text, F.concat(F.lit("nation-"), F.col("c_nationkey")))


_CARDS = r"""cards as (
  select 'card-' || c_custkey as path, 'nation-' || c_nationkey as skill, concat_ws(chr(10),
    'owner: ' || c_name,
    'See https://' || lower(c_mktsegment) || '.example.io/' || case when c_custkey % 3 = 0 then 'mcp' else 'about' end || '.',
    '', '```', '  token: ${TOKEN_' || c_custkey || '}', 'run: job ' || c_custkey,
    'fetch https://files' || (c_custkey % 7) || '.example.net/x', '```',
    'Password: ' || case when c_custkey % 2 = 0 then 'changeme' else 'hunter' || c_custkey end,
    'at 10.0.' || (c_custkey % 256) || '.7 or http://203.0.114.' || (c_custkey % 256) || '/in',
    'Bill the ' || lower(c_mktsegment) || ' account with ' || case c_custkey % 5 when 0 then 'stripe' when 1 then 'slack' else 'post' end || case when c_custkey % 4 = 0 then ' and a payment' else '' end) as raw
  from customer where c_custkey is not null and c_name is not null and c_mktsegment is not null
)"""


def _lines(of: str) -> str:
    """CTEs fields(path, skill, line, value, key, in_code, field_source) of a relation (path, skill, raw)."""
    excluded = ", ".join(f"'{w}'" for w in sorted(terms.NOT_KEYS))
    return rf"""split as (
  select path, skill, string_split_regex(raw, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as ls from {of}
), numbered as (
  select path, skill, unnest(ls) as text, unnest(range(1, len(ls) + 1)) as line from split
), marked as (
  select *, regexp_extract(text, '^\s*(`|~)(`|~)(`|~)', 1) as fence from numbered
), counted as (
  select *, count(case when fence <> '' then 1 end) over (partition by path order by line rows unbounded preceding) as fences from marked
), fields as (
  select path, skill, line, value, left(value, 200) as snippet, key, in_code, case when in_code then 'code_block' when key is not null then 'config_line' else 'prose' end as field_source
  from (
    select path, skill, line, regexp_replace(text, '^\s+|\s+$', '', 'g') as value, fences % 2 = 1 or fence <> '' as in_code,
      case when regexp_extract(text, '^\s*([A-Za-z0-9_-]{{2,}})\s*:', 1) <> '' and lower(regexp_extract(text, '^\s*([A-Za-z0-9_-]{{2,}})\s*:', 1)) not in ({excluded})
        then regexp_extract(text, '^\s*([A-Za-z0-9_-]{{2,}})\s*:', 1) end as key
    from counted
  ) where value <> ''
)"""


def _finding(rule_id: str, title: str, found: str) -> str:
    """Findings of a relation (path, skill, line, snippet, score, description)."""
    title = title.replace("'", "''")
    return f"""
select left(sha256(concat_ws('|', skill, '{rule_id}', '{title}', description, path, coalesce(line::varchar, 'None'), snippet)), 16) as id, skill, '{rule_id}' as rule_id,
  case when score >= 80 then 'high' when score >= 50 then 'medium' else 'low' end as severity, score::bigint as score, description, path, line::bigint as line, snippet
from ({found})"""


_DOCS = "docs as (select 'doc-' || doc_id as path, source as skill, text as raw from documents where text is not null)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the bundled rules over the documents."""
    return told(scan(tables.documents(spark, sf_dir), _rules()))


@query()
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundled rules that look at one text, without front matter, over the documents; README names those left out."""
    return flagship(spark, sf_dir)


@query()
def scan_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of scan_documents over the composed documents, with suppression."""
    return told(scan(cards(spark, sf_dir), _rules()))


@query(f"with {_CARDS}, {_lines('cards')} select path, line::bigint as line, field_source, key, in_code as in_code_block, snippet from fields")
def field_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their keys and whether fences hold them."""
    parsed = parse(cards(spark, sf_dir), front_matter=False)
    return parsed.select("path", F.explode_outer("fields").alias("f")).filter("f is not null").select("path", F.col("f.line").cast("long").alias("line"), "f.field_source", "f.key", "f.in_code_block", "f.snippet")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(
    f"with {_DOCS}, {_lines('docs')}, found as ("
    + rf"""
  select path, skill, line, snippet, list_filter(regexp_extract_all(value, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b'), lambda a: regexp_full_match(a, '{_OCTET}(?:\.{_OCTET}){{3}}'))[1] as ip from fields
), split_ip as (
  select *, string_split(ip, '.')[1]::int as a, string_split(ip, '.')[2]::int as b, string_split(ip, '.')[3]::int as c, string_split(ip, '.')[4]::int as d from found where ip is not null
), judged as (
  select *, not (a = 192 and b = 0 and c = 0 and d in (9, 10)) and (a in (0, 10, 127) or a >= 224 or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 192 and b = 0 and c in (0, 2)) or (a = 198 and b in (18, 19)) or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113)) as closed from split_ip
)"""
    + _finding(
        "NET_RAW_IP", "Raw IP endpoint in config",
        "select distinct path, skill, line, snippet, case when closed then 50 else 82 end as score, case when closed then 'Configuration references a non-public raw IP address (' || ip || ').' else 'Configuration references a public raw IP address (' || ip || '), bypassing domain controls.' end as description from judged",
    )
)
def ip_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(tables.documents(spark, sf_dir), _rules("NET_RAW_IP")))


@query(
    f"with {_DOCS}, {_lines('docs')}, chars as (select path, skill, line, snippet, length(value) as n, unnest(string_split(value, '')) as c from fields where length(value) >= 40), "
    + "parts as (select path, skill, line, snippet, n, c, count(*) as k from chars group by all), "
    + "dense as (select path, skill, line, snippet, -sum(k / n * log2(k / n)) as bits from parts group by all)"
    + _finding("OPAQUE_BLOB", "Opaque or encoded blob detected", "select path, skill, line, snippet, 54 as score, 'Long or high-entropy value may hide encoded payloads.' as description from dense where bits >= 4.15")
)
def entropy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more, prose among them, by their entropy."""
    rules = _changed("OPAQUE_BLOB", min_length=40, min_entropy=4.15, skip_prose=False, base64_pattern=None, scan_frontmatter=False)
    return told(scan(tables.documents(spark, sf_dir), rules))


@query(
    "with docs as (select 'page-' || page_id as path, 'page-' || page_id as skill, html as raw from pages where html is not null), "
    + _lines("docs")
    + r""", tokens as (
  select path, skill, line, unnest(list_filter(string_split_regex(value, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9_]{3,}') and (starts_with(x, 'DOC') or starts_with(x, 'HT')))) as token from fields
), per_doc as (
  select path, skill, min(line) as line, count(distinct token) as n, list_sort(list_distinct(list(token))) as ts from tokens group by path, skill
)"""
    + _finding(
        "TOOL_INVOCATION", "Tool invocation tokens in docs",
        "select path, skill, line, array_to_string(ts[1:5], ', ') || case when n > 5 then ' (+' || (n - 5) || ' more)' else '' end as snippet, least(50, 20 + 2 * least(n, 10)) as score, 'Skill references ' || n || ' tool invocation token' || case when n = 1 then '' else 's' end || '. Tiers: ' || n || ' read.' as description from per_doc",
    )
)
def tool_tokens_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(tables.pages(spark, sf_dir), _changed("TOOL_INVOCATION", scan_service_tokens=False), Config(tool_prefixes=("DOC", "HT"), destructive=(), write=())))


_STRONG, _WEAK = ["the ", " in", "clown", "stupid"], ["ed ", " of", "trash"]


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_NEGATIONS = list(terms.NEGATIONS)


@query(
    f"with {_DOCS}, {_lines('docs')}, hints as (select unnest({_sql_list(_STRONG + _WEAK)}) as hint, unnest(range(0, {len(_STRONG + _WEAK)})) as place), "
    + f"""low as (select path, skill, line, lower(text) as t from numbered), uses as (
  select distinct path, skill, place, hint from low join hints on contains(t, hint)
  where not list_bool_or(list_transform({_sql_list(_NEGATIONS)}, lambda p: contains(substring(t, greatest(1, instr(t, hint) - 30)::bigint, least(30, instr(t, hint) - 1)::bigint), p)))
), enough as (
  select path, skill, arg_min(hint, place) as hint from uses group by path, skill having count(*) >= 3 and count(case when place < {len(_STRONG)} then 1 end) >= 1
), clear as (
  select e.path, min(f.line) as line from enough e join fields f on e.path = f.path and contains(lower(f.value), e.hint)
  where not list_bool_or(list_transform({_sql_list(_NEGATIONS)}, lambda p: contains(substring(lower(f.value), greatest(1, instr(lower(f.value), e.hint) - 30)::bigint, least(30, instr(lower(f.value), e.hint) - 1)::bigint), p)))
  group by e.path
), loose as (
  select e.path, min(f.line) as line from enough e join fields f on e.path = f.path and contains(lower(f.value), string_split(e.hint, ' ')[1]) group by e.path
), placed as (
  select e.path, e.skill, coalesce(c.line, l.line, 1) as line from enough e left join clear c on c.path = e.path left join loose l on l.path = e.path
)"""
    + _finding(
        "AUTH_CONNECTION", "Auth/connection requirements in docs",
        "select p.path, p.skill, p.line, f.snippet, 45 as score, 'Docs include authentication or connection setup requirements.' as description from placed p join fields f on f.path = p.path and f.line = p.line",
    )
)
def hint_count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three of seven hints that aren't negated, one of them strong."""
    return told(scan(tables.documents(spark, sf_dir), _changed("AUTH_CONNECTION", strong_hints=_STRONG, weak_hints=_WEAK, min_hint_count=3)))


@query(
    "with docs as (select concat_ws('-', 'turn', conv_id, turn) as path, 'conv-' || conv_id as skill, text as raw from conversations where text is not null), "
    + _lines("docs")
    + """, uses as (
  select path, skill, case when contains(lower(raw), 'hank') then 'hank' when contains(lower(raw), 'the th') then 'the' end as word from docs
), placed as (select u.path, u.skill, min(f.line) as line from uses u join fields f on f.path = u.path and contains(lower(f.value), u.word) where u.word is not null group by u.path, u.skill)"""
    + _finding("DYNAMIC_SCHEMA", "Dynamic schema discovery guidance", "select p.path, p.skill, p.line, f.snippet, 15 as score, 'Docs suggest discovering tools/schema at runtime before execution.' as description from placed p join fields f on f.path = p.path and f.line = p.line")
)
def keyword_first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(tables.turns(spark, sf_dir), _changed("DYNAMIC_SCHEMA", hints=["hank", "the th"])))


@query(
    f"with {_CARDS}, {_lines('cards')}"
    + _finding(
        "SECRET_REF", "Secret-like key in config",
        r"select path, skill, line, snippet, 74 as score, 'Key ''' || key || ''' appears to store or reference sensitive credentials.' as description from fields where regexp_matches(lower(key), 'api_key|apikey|token|secret|password|credential|private_key|auth') and not regexp_matches(value, '(?i)<\s*placeholder\s*>|\b(?:changeme|todo|xxx+)\b|\b(?:replace|your)[-_]')",
    )
)
def secret_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(cards(spark, sf_dir), _rules("SECRET_REF_KEYS")))


@query(
    f"with {_CARDS}, {_lines('cards')}"
    + _finding("EXEC_FIELDS", "Executable field in config", "select path, skill, line, snippet, 72 as score, 'Field ''' || key || ''' declares command-like behavior.' as description from fields where lower(key) in ('command', 'script', 'exec', 'shell', 'run', 'hook', 'entrypoint', 'owner')")
)
def exec_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(cards(spark, sf_dir), _changed("EXEC_FIELDS", keywords=["command", "script", "exec", "shell", "run", "hook", "entrypoint", "owner"])))


@query(
    f"with {_CARDS}, {_lines('cards')}"
    + _finding("SECRET_REF", "Environment secret reference", r"select path, skill, line, snippet, 60 as score, 'Configuration includes environment secret references.' as description from fields where regexp_matches(value, '(?i)\$\{[A-Z0-9_]*(?:api_key|apikey|auth|credential|key|passwd|password|private|secret|token)[A-Z0-9_]*\}')")
)
def env_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(cards(spark, sf_dir), _rules("SECRET_REF")))


_HITS = r""", urls as (
  select path, skill, line, snippet, field_source, regexp_replace(unnest(regexp_extract_all(value, '(?i)https?://[^\s"''<>]+')), '[)`*.,;:!?\]]+$', '') as url from fields
), hosts as (select *, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) as host from urls)"""
_ALLOWED = "(host = 'example.net' or host like '%.example.net' or host = 'machinery.example.io')"


@query(
    f"with {_CARDS}, {_lines('cards')}{_HITS}"
    + _finding("NET_DOC_DOMAIN", "Non-allowlisted domain in docs", rf"select distinct path, skill, line, snippet, case when host = 'building.example.io' then 80 else 15 end as score, case when host = 'building.example.io' then 'Documentation references ''' || host || ''', which is denylisted.' else 'Documentation references external domain ''' || host || '''.' end as description from hosts where field_source = 'prose' and not regexp_matches(host, '^[0-9.]+$') and (host = 'building.example.io' or not {_ALLOWED})")
)
def doc_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(cards(spark, sf_dir), _rules("NET_DOC_DOMAIN"), Config(allowlist_domains=("example.net", "machinery.example.io"), denylist_domains=("building.example.io",), ignore_default_allowlist=True)))


@query(
    f"with {_CARDS}, {_lines('cards')}{_HITS}"
    + _finding("NET_UNKNOWN_DOMAIN", "Non-allowlisted domain in config", "select distinct path, skill, line, snippet, 35 as score, 'Configuration references external domain ''' || host || '''.' as description from hosts where field_source in ('config_line', 'code_block') and not regexp_matches(host, '^[0-9.]+$')")
)
def config_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(cards(spark, sf_dir), _rules("NET_UNKNOWN_DOMAIN"), Config(ignore_default_allowlist=True)))


@query(
    f"with {_CARDS}, {_lines('cards')}{_HITS}"
    + _finding("MCP_ENDPOINT", "MCP endpoint in docs", "select distinct path, skill, line, snippet, 70 as score, 'Documentation references MCP endpoint ''' || url || '''.' as description from hosts where regexp_matches(url, '/mcp(?:/|$)') and host <> 'household.example.io'")
)
def mcp_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(cards(spark, sf_dir), _rules("MCP_ENDPOINT"), Config(mcp_allowlist_domains=("household.example.io",))))


@query(
    f"with {_CARDS}, {_lines('cards')}{_HITS}"
    + _finding("REMOTE_REFERENCE_RISK", "Risky remote reference detected", "select path, skill, line, url as snippet, 70 as score, 'Remote references look unsafe: plain http, schemes that run or read local things, shortened links, or orders to fetch and apply. Detected: insecure http:// to ''' || host || ''' at line ' || line || '.' as description from hosts where starts_with(url, 'http://')")
)
def remote_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(scan(cards(spark, sf_dir), _rules("REMOTE_REFERENCE_RISK")))


@query(
    f"with {_CARDS}, {_lines('cards')}"
    + r""", words as (
  select path, skill, line, snippet, list_contains(string_split_regex(lower(value), '[^a-z0-9_]+'), 'stripe') as high, list_contains(string_split_regex(lower(value), '[^a-z0-9_]+'), 'slack') as medium, list_contains(string_split_regex(lower(value), '[^a-z0-9_]+'), 'payment') as word from fields where starts_with(value, 'Bill')
), levels as (select *, case when high then 'high' when medium and word then 'medium' end as tier from words)"""
    + _finding(
        "DATA_SENSITIVITY", "Data sensitivity classification",
        """select path, skill, line, snippet, least(100, case coalesce(tier, 'high') when 'high' then 65 else 40 end + case when word then 10 else 0 end) as score,
  concat_ws(' ', case tier when 'high' then 'Skill text references service ''stripe'' (high-sensitivity service).' when 'medium' then 'Skill text references service ''slack'' (medium-sensitivity service).' else 'Skill text contains high-sensitivity data keywords.' end,
  'Category: ' || case tier when 'medium' then 'messaging' else 'financial' end || ' (category_source=' || case when tier is null then 'keyword' else 'service' end || ').',
  'signal_source=' || concat_ws('+', case when tier is not null then 'service_text' end, case when word then 'keyword_high' end) || '.',
  case when word then 'High-sensitivity keywords: payment.' end) as description from levels where tier is not null or word""",
    )
)
def data_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Config(sensitivity=Sensitivity({"high": ("stripe",), "medium": ("slack",), "low": ()}, {"high": ("payment",), "medium": ()}))
    return told(scan(cards(spark, sf_dir), _rules("DATA_SENSITIVITY"), config))


@query(
    r"""with words as (select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as w from benchmark where text is not null), long as (select w from words where length(w) >= 5)
select a.w as name, b.w as value, levenshtein(a.w, b.w)::bigint as distance from long a join long b on a.w <> b.w and levenshtein(a.w, b.w) <= 2"""
)
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark within two edits of each other: the join of the name check."""
    words = tables.read(spark, sf_dir, "benchmark").filter("text is not null").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).distinct()
    return across.near_names(words, words).select("name", "value", F.col("distance").cast("long").alias("distance"))


@query(
    """with docs as (select '/r/' || o_orderstatus || '/' || o_custkey || '/' || o_orderkey || '/SKILL.md' as path, o_orderstatus as s, o_custkey as c from orders),
files as (select '/r/.mcp.json' as f, 1 as depth, null as s, null as c union all select distinct '/r/' || o_orderstatus || '/.mcp.json', 2, o_orderstatus, null from orders where o_orderstatus <> 'F'
  union all select '/r/F/' || c_custkey || '/.mcp.json', 3, 'F', c_custkey from customer where c_acctbal > 0)
select path, arg_max(f, depth) as above from docs d join files on (files.s is null or files.s = d.s) and (files.c is null or files.c = d.c) group by path"""
)
def nearest_server_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest file above each document of a tree."""
    orders, customers = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "customer")
    docs = tables.spread(orders, "o_orderkey", 300_000).select(F.concat_ws("/", F.lit("/r"), "o_orderstatus", "o_custkey", "o_orderkey", F.lit("SKILL.md")).alias("path"))
    top = spark.range(1).select(F.lit("/r/.mcp.json").alias("path"))
    middle = orders.filter("o_orderstatus <> 'F'").select(F.concat_ws("/", F.lit("/r"), "o_orderstatus", F.lit(".mcp.json")).alias("path")).distinct()
    low = customers.filter("c_acctbal > 0").select(F.concat_ws("/", F.lit("/r/F"), "c_custkey", F.lit(".mcp.json")).alias("path"))
    return across.nearest_above(docs, top.union(middle).union(low))


@query(
    """select 'c' || o_custkey as skill, '/r/c' || o_custkey || '/SKILL.md' as path, left(array_to_string(list_sort(list(o_orderpriority || '/o' || o_orderkey || '.sh')), ', '), 200) as snippet
from orders where o_orderpriority not like '5%' and o_custkey in (select c_custkey from customer) group by o_custkey"""
)
def bundled_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts in the folders of documents: orders as files below their customers."""
    docs = tables.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("skill"), F.concat(F.lit("/r/c"), "c_custkey", F.lit("/SKILL.md")).alias("path"))
    suffix = F.when(F.col("o_orderpriority").startswith("5"), ".md").otherwise(".sh")
    files = tables.spread(tables.read(spark, sf_dir, "orders"), "o_orderkey", 300_000).select(F.concat(F.lit("/r/c"), "o_custkey", F.lit("/"), "o_orderpriority", F.lit("/o"), "o_orderkey", suffix).alias("path"))
    return across.bundled_scripts(docs, files, *_rules("BUNDLED_SCRIPTS"), Config()).select("skill", "path", "snippet")


_KINDS = ["MCP_ENDPOINT", "NET_DOC_DOMAIN", "NET_UNKNOWN_DOMAIN", "HIDDEN_INSTRUCTION", "UNICODE_BIDI_CONTROL", "OPAQUE_BLOB", "INSTR_OBFUSCATED_PAYLOAD", "CONFUSABLE_IDENTIFIER_EXTENDED", "REMOTE_REFERENCE_RISK"]


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidates: the order is the document, the ship mode of quantities the rule."""
    rows = tables.read(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("path"), (F.col("l_suppkey") % 4).cast("long").alias("line"), F.concat(F.lit("supplier-"), "l_suppkey").alias("skill"),
        F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % len(_KINDS)).cast("int") + 1).alias("rule_id"),
        (F.col("l_quantity") * 2).cast("int").alias("score"), F.col("l_returnflag").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


_LINE_CANDIDATES = f"""cands as (select l_orderkey::varchar as path, l_suppkey % 4 as line, 'supplier-' || l_suppkey as skill, ({_sql_list(_KINDS)})[(l_partkey % {len(_KINDS)}) + 1] as rule_id, floor(l_quantity * 2)::bigint as score, l_returnflag as description, l_orderkey * 10 + l_linenumber as seq from lineitem)"""


@query(
    f"""with {_LINE_CANDIDATES} select path, line, rule_id, score, seq from cands c where not exists (select 1 from cands m where m.path = c.path and m.line is not distinct from c.line and (
  (m.rule_id = 'MCP_ENDPOINT' and c.rule_id in ('NET_DOC_DOMAIN', 'NET_UNKNOWN_DOMAIN') and c.score <= m.score) or (m.rule_id = 'REMOTE_REFERENCE_RISK' and c.rule_id in ('NET_DOC_DOMAIN', 'NET_UNKNOWN_DOMAIN'))
  or (m.rule_id in ('UNICODE_BIDI_CONTROL', 'CONFUSABLE_IDENTIFIER_EXTENDED') and c.rule_id = 'HIDDEN_INSTRUCTION') or (m.rule_id = 'INSTR_OBFUSCATED_PAYLOAD' and c.rule_id = 'OPAQUE_BLOB')))"""
)
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no other candidate on the line covers."""
    return suppress_rows(line_candidates(spark, sf_dir)).select("path", "line", "rule_id", F.col("score").cast("long").alias("score"), "seq")


@query(f"with {_LINE_CANDIDATES} select path, line, rule_id, description, score, seq from cands qualify row_number() over (partition by rule_id, path, line, description order by seq, skill, score) = 1")
def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(line_candidates(spark, sf_dir), "seq").select("path", "line", "rule_id", "description", F.col("score").cast("long").alias("score"), "seq")


_OVERRIDES = {"OPAQUE_BLOB": Override(max_severity="low"), "NET_DOC_DOMAIN": Override(min_severity="medium"), "HIDDEN_INSTRUCTION": Override(min_severity="medium", max_severity="medium")}


def line_findings(spark: SparkSession, sf_dir: str, config: Config | None = None) -> DataFrame:
    """Line items as findings."""
    rows = line_candidates(spark, sf_dir).withColumns({
        "internal_rule_id": F.col("rule_id"), "confidence": F.lit("high"), "title": F.lit("Line"), "snippet": F.col("seq").cast("string"), "recommendation": F.lit(""),
        "classification": F.when(F.col("description") == "N", "informational").otherwise("security"),
    })
    return to_findings(rows, config or Config())


_LINE_FINDINGS = f"""{_LINE_CANDIDATES}, findings as (select *, left(sha256(concat_ws('|', skill, rule_id, 'Line', description, path, coalesce(line::varchar, 'None'), seq::varchar)), 16) as id,
  case when score >= 80 then 'high' when score >= 50 then 'medium' else 'low' end as severity, case when description = 'N' then 'informational' else 'security' end as classification from (select * replace (greatest(0, least(100, score)) as score) from cands))"""


@query(
    f"""with {_LINE_FINDINGS} select id, new_score::bigint as score, case when new_score >= 80 then 'high' when new_score >= 50 then 'medium' else 'low' end as severity, case when new_score <> score then severity end as original
from (select *, case rule_id when 'OPAQUE_BLOB' then least(score, 49) when 'NET_DOC_DOMAIN' then greatest(score, 50) when 'HIDDEN_INSTRUCTION' then least(79, greatest(score, 50)) else score end as new_score from findings)"""
)
def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids, and severities under a policy's bounds."""
    findings = line_findings(spark, sf_dir, Config(overrides=_OVERRIDES))
    return findings.select("id", F.col("score").cast("long").alias("score"), "severity", F.col("severity_override.original").alias("original"))


_SCORES = "round_even(100 * (1 - coalesce(product(1 - best / 100), 1)), 0)::bigint"


@query(f"with {_LINE_FINDINGS}, best as (select skill, rule_id, max(score) as best from findings group by all) select skill, coalesce(round_even(100 * (1 - product(1 - best / 100) filter (best >= 40)), 0), 0)::bigint as overall_score from best group by skill")
def score_per_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.overall_scores(line_findings(spark, sf_dir), ["skill"], 40)
    return scores.select("skill", F.col("overall_score").cast("long").alias("overall_score"))


@query(
    f"""with {_LINE_FINDINGS}, best as (select rule_id, max(score) as best from findings group by all)
select {_SCORES} as aggregate_score, case when {_SCORES} >= 80 then 'high' when {_SCORES} >= 50 then 'medium' else 'low' end as aggregate_severity, (select count(*) from findings) as total_findings,
  (select count(*) from findings where severity = 'high') as high, (select count(*) from findings where severity = 'medium') as medium, (select count(*) from findings where severity = 'low') as low from best where best >= 40"""
)
def score_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = score.workspace(line_findings(spark, sf_dir), Config())
    return whole.select(*[F.col(c).cast("long").alias(c) for c in ("aggregate_score", "total_findings", "high", "medium", "low")], "aggregate_severity")


@query(f"with {_LINE_FINDINGS} select skill, count(*) as findings, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low, count(distinct rule_id) as rules from findings group by skill")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the summaries of skills."""
    whole = score.summaries(line_findings(spark, sf_dir), Config())
    counts = {level: F.coalesce(F.element_at("counts_by_severity", level), F.lit(0)).cast("long") for level in ("high", "medium", "low")}
    return whole.select("skill", F.col("finding_count").cast("long").alias("findings"), *[c.alias(n) for n, c in counts.items()], F.size("counts_by_rule").cast("long").alias("rules"))


@query(f"with {_LINE_FINDINGS} select skill, id, score::bigint as score, row_number() over (partition by skill order by score desc, id) as rank from findings qualify rank <= 5")
def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest findings of each skill."""
    return score.top_risks(line_findings(spark, sf_dir), ["skill"]).select("skill", "id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_LINE_FINDINGS} select skill, rule_id, count(*) as n from findings group by all")
def counts_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = score.count_by_rule(line_findings(spark, sf_dir), ["skill"])
    return counts.select("skill", F.explode("counts_by_rule").alias("rule_id", "n")).withColumn("n", F.col("n").cast("long"))


@query(f"with {_LINE_FINDINGS} select count(*) filter (severity <> 'low' and classification = 'security') as shown, count(*) as total, count(*) filter (severity = 'low') as below_severity, count(*) filter (severity <> 'low' and classification <> 'security') as informational from findings")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.filtered_reasons(line_findings(spark, sf_dir), min_severity="medium", security_only=True)


@query(
    f"with {_CARDS}, {_lines('cards')}{_HITS}, f as (select distinct path, line, host from hosts where field_source = 'prose' and not regexp_matches(host, '^[0-9.]+$')) select 'NET_DOC_DOMAIN' as rule_id, host as domain, count(*) as n, sum(count(*)) over ()::bigint as total from f group by host"
)
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the findings that an allowlist could silence."""
    return score.domain_counts(scan(cards(spark, sf_dir), _rules("NET_DOC_DOMAIN"), Config(ignore_default_allowlist=True)))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events where ts is not null group by all")
def events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the stream's counts, over the whole table at once."""
    return windowed_counts(tables.read(spark, sf_dir, "events"))


def unsuppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_candidates(cards(spark, sf_dir), _rules(), Config(), suppress=False)

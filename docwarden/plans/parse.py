"""From raw texts to documents with lines, keys and front matter.

Lines, keys and fences are found in the JVM, without exploding a document.  Only
YAML needs Python; it gets the front matter alone, and only with
``front_matter=True``.
"""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden import terms
from docwarden.functions.names import output_name
from docwarden.functions.text import let, lines_of, strip

FRONT_MATTER = "struct<error:string,name:string,kv:array<struct<key:string,value:string,line:int>>,paths:array<struct<path:string,empty:boolean>>,mcp:array<string>>"
_BOM = "﻿"
#: Front matter that LibYAML reads as PyYAML's own parser does, many times faster: block mappings whose values are
#: plain or empty, or lists of plain words in brackets; neither quotes (but for empty ones), tabs, comments nor tags
_WORD = r"[^\W_][\w./-]*(?: [^\W_][\w./-]*)*"
_SIMPLE = re.compile(rf'(?: *[A-Za-z][\w-]*:(?: (?:{_WORD}|""|\[\]|\[{_WORD}(?:, {_WORD})*\])?)?(?:\n|\Z))+', re.ASCII)
#: letters of the basic plane, of which neither parser makes anything else
_LETTERS = re.compile("[\u00c0-\u024f\u0370-\u0481\u048a-\u052f]")
_FAST = getattr(yaml, "CSafeLoader", None)


def _empty(value: object) -> bool:
    if isinstance(value, str):
        return not value.strip()
    return isinstance(value, (list, tuple, dict)) and not value


def _load(text: str) -> object:
    """What yaml.safe_load gives, or its error."""
    # short ones, so that nesting stays shallow
    if _FAST and len(text) <= 4096 and _SIMPLE.fullmatch(_LETTERS.sub("a", text)):
        try:
            return yaml.load(text, Loader=_FAST)
        except yaml.YAMLError:
            pass  # for the words of the error
    return yaml.safe_load(text)


def read_front_matter(text: str | None) -> dict | None:
    """Error, declared name, string leaves with their lines, dotted paths and required servers of a front matter."""
    if text is None:
        return None
    result: dict = {"error": None, "name": None, "kv": [], "paths": [], "mcp": []}
    try:
        data = _load(text)
    except yaml.YAMLError as error:
        return result | {"error": f"invalid YAML: {' '.join(str(error).split())}"}
    if data is None:
        return None
    if not isinstance(data, dict):
        return result | {"error": "front matter is not a mapping"}
    lines: dict[str, int] = {}
    for number, line in enumerate(text.split("\n"), 2):
        key, colon, _ = line.strip().removeprefix("-").strip().partition(":")
        if colon and key.rstrip().replace("-", "a").replace("_", "a").isalnum() and key.isascii():
            lines.setdefault(key.rstrip().lower(), number)

    def walk(prefix: str, value: object, named: bool) -> None:
        if named and value is not None:
            result["paths"].append({"path": prefix, "empty": _empty(value)})
        if isinstance(value, str):
            result["kv"].append({"key": prefix, "value": value, "line": lines.get(prefix.rsplit(".", 1)[-1].strip().lower(), 1)})
        elif isinstance(value, dict):
            for key, inner in value.items():
                walk(f"{prefix}.{key}" if prefix else str(key), inner, named)
        elif isinstance(value, (list, tuple)):
            for i, inner in enumerate(value):
                # lists in lists hold no leaves
                if isinstance(inner, (str, dict)):
                    walk(f"{prefix}.{i}", inner, False)

    walk("", data, True)
    result["paths"] = [p for p in result["paths"] if p["path"]]
    name = data.get("name")
    if isinstance(name, str) and name.strip():
        result["name"] = name.strip()
    requires = data.get("requires")
    servers = requires.get("mcp") if isinstance(requires, dict) else None
    if isinstance(servers, str):
        servers = [servers]
    if isinstance(servers, (list, tuple)):
        result["mcp"] = sorted({s.strip() for s in servers if isinstance(s, str) and s.strip()})
    return result


def _front_matter(texts: pd.Series) -> pd.DataFrame:
    rows = [read_front_matter(t) or {"error": None, "name": None, "kv": None, "paths": None, "mcp": None} for t in texts]
    return pd.DataFrame(rows, columns=["error", "name", "kv", "paths", "mcp"])


def _fence_spans(lines: Column) -> Column:
    """Intervals (lo, hi) of line indices within fences, the fence lines included; an open fence runs to the end."""
    found = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.when(line.rlike("[`~]{3}"), F.substring(F.regexp_extract(line, r"^\s*([`~]{3,})", 1), 1, 1)).otherwise("").alias("mark"))),
        lambda m: m["mark"] != "",
    )
    spans = "array<struct<lo:int,hi:int>>"
    start = F.struct(F.lit("").alias("mark"), F.lit(0).alias("lo"), F.array().cast(spans).alias("spans"))

    def step(state: Column, m: Column) -> Column:
        opened = F.struct(m["mark"].alias("mark"), m["at"].alias("lo"), state["spans"].alias("spans"))
        closed = F.struct(F.lit("").alias("mark"), F.lit(0).alias("lo"), F.concat(state["spans"], F.array(F.struct(state["lo"].alias("lo"), m["at"].alias("hi")))).alias("spans"))
        return F.when(state["mark"] == "", opened).when(state["mark"] == m["mark"], closed).otherwise(state)

    def finish(state: Column) -> Column:
        rest = F.array(F.struct(state["lo"].alias("lo"), F.lit(2147483647).alias("hi")))
        return F.when(state["mark"] == "", state["spans"]).otherwise(F.concat(state["spans"], rest))

    return let(found, lambda marks: F.when(F.size(marks) == 0, F.array().cast(spans)).otherwise(F.aggregate(marks, start, step, finish)))


def _fields(lines: Column, spans: Column, skip: Column) -> Column:
    """Fields of the lines behind the first ``skip`` ones that aren't blank; lines are numbered in the file."""
    body = F.slice(lines, skip + 1, F.greatest(F.size(lines) - skip, F.lit(0)))

    def field(line: Column, i: Column) -> Column:
        found = let(F.regexp_extract(line, r"(?U)^\s*([A-Za-z0-9_-]{2,})\s*:", 1), lambda k: F.when((k != "") & ~F.lower(k).isin(*sorted(terms.NOT_KEYS)), k))
        in_code = F.exists(spans, lambda s: (s["lo"] <= i) & (i <= s["hi"]))
        parts = F.struct(strip(line).alias("value"), found.alias("key"), in_code.alias("in_code"), (i + skip + 1).cast("int").alias("line"))
        return let(
            parts,
            lambda p: F.struct(
                p["line"].alias("line"), p["value"].alias("value"), F.substring(p["value"], 1, terms.SNIPPET).alias("snippet"), p["in_code"].alias("in_code_block"),
                F.when(p["in_code"], "code_block").when(p["key"].isNotNull(), "config_line").otherwise("prose").alias("field_source"), p["key"].alias("key"),
            ),
        )

    return F.filter(F.transform(body, field), lambda f: f["value"] != "")


def parse(docs: DataFrame, *, front_matter: bool = True) -> DataFrame:
    """Adds to documents (path, raw_text, ...) what the operators read.

    lines: of the text without a leading byte order mark; fields: the lines of the
    body that aren't blank; body_start: how many lines come before the body; fm:
    the front matter, null if there is none; parse_error: why a document can't be
    read.  A null text is an error, an empty one has no fields.  With
    ``front_matter=False`` the whole text is the body.
    """
    plain = docs.withColumn("lines", lines_of(F.regexp_replace("raw_text", f"^{_BOM}+", "")))
    if front_matter:
        opened = (F.size("lines") > 0) & (strip(F.get("lines", F.lit(0))) == "---")
        close = F.array_position(F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: strip(x).isin("---", "...")), True)
        plain = plain.withColumn("fm_lines", F.when(opened, close)).withColumn("body_start", F.coalesce(F.when(F.col("fm_lines") > 0, F.col("fm_lines") + 1), F.lit(0)).cast("int"))
        text = F.when(F.col("fm_lines") > 0, F.array_join(F.slice("lines", F.lit(2), F.greatest(F.col("fm_lines") - 1, F.lit(0)).cast("int")), "\n"))
        # called nondeterministic so that filters on its result don't make Spark call it twice
        plain = plain.withColumn("fm", F.pandas_udf(_front_matter, FRONT_MATTER).asNondeterministic()(text))
        unclosed = F.when(F.col("fm_lines") == 0, F.lit("front matter is not closed"))
        plain = plain.withColumn("parse_error", F.coalesce(unclosed, F.col("fm.error"), F.when(F.col("raw_text").isNull(), F.lit("no valid UTF-8 text")))).drop("fm_lines")
    else:
        plain = plain.withColumn("body_start", F.lit(0)).withColumn("fm", F.lit(None).cast(FRONT_MATTER)).withColumn("parse_error", F.when(F.col("raw_text").isNull(), F.lit("no valid UTF-8 text")))
    body_lines = F.slice("lines", F.col("body_start") + 1, F.greatest(F.size("lines") - F.col("body_start"), F.lit(0)))
    return plain.withColumn("fields", F.when(F.col("raw_text").isNotNull(), let(_fence_spans(body_lines), lambda spans: _fields(F.col("lines"), spans, F.col("body_start")))))


def name_documents(parsed: DataFrame) -> DataFrame:
    """Adds ``skill``: the declared name, else the folder's, else the path's; names that collide get a digest of the path.

    ``rel_path`` is the path below the root.
    """
    folder = F.element_at(F.split("rel_path", "/"), -2)
    base = output_name(F.coalesce(F.col("fm.name"), F.when(F.size(F.split("rel_path", "/")) > 1, folder), F.col("folder"), F.col("rel_path")))
    named = parsed.withColumn("base_name", base)
    # only names that collide are joined back, so that texts don't move
    shared = named.groupBy("base_name").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("base_name").alias("__shared"))
    joined = named.join(shared, named["base_name"] == shared["__shared"], "left")
    unique = F.concat("base_name", F.lit("-"), F.substring(F.sha2("rel_path", 256), 1, 8))
    return joined.withColumn("name_collides", F.col("__shared").isNotNull()).withColumn("skill", F.when(F.col("name_collides"), unique).otherwise(F.col("base_name"))).drop("base_name", "__shared")

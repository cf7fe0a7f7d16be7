"""Operators over the whole text of a document, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden import terms
from docwarden.config import Config
from docwarden.functions import net
from docwarden.functions.text import let, lines_of, negated_in, preview, strings, strip
from docwarden.operators.fields import no_signals, one, signal
from docwarden.rulepack import Rule


def _first_line() -> Column:
    return F.struct(F.lit(1).alias("line"), F.substring(F.coalesce(F.get(lines_of(F.col("raw_text")), F.lit(0)), F.lit("")), 1, terms.SNIPPET).alias("snippet"))


def _place_of(fields: Column) -> Column:
    """Place of the first field of an array, or null."""
    return let(F.get(fields, F.lit(0)), lambda f: F.when(f.isNotNull(), F.struct(f["line"].alias("line"), f["snippet"].alias("snippet"))))


def _with_word(word: str) -> Column:
    return _place_of(F.filter(F.col("fields"), lambda f: F.contains(F.lower(f["value"]), F.lit(word.lower()))))


def hint_count(rule: Rule, config: Config) -> Column:
    """One signal if enough of the hints occur without a negation before them."""
    match = rule.match
    strong, weak = match.get("strong_hints", []), match.get("weak_hints", [])
    if not strong and not weak:
        return no_signals()
    aware = match.get("negation_aware", False)
    low = F.lower(F.col("raw_text"))

    def used(text: Column, hint: Column) -> Column:
        # lines are looked at only for hints that occur
        clear = F.exists(text["lines"], lambda line: F.contains(line, hint) & ~negated_in(line, hint, terms.NEGATIONS)) if aware else F.lit(True)
        return F.when(F.contains(text["low"], hint), clear).otherwise(F.lit(False))

    def report(s: Column) -> Column:
        best = F.coalesce(F.get(s["strong"], F.lit(0)), F.get(s["weak"], F.lit(0)))

        def place_of(best: Column) -> Column:
            lower = F.transform(F.col("fields"), lambda f: F.struct(F.lower(f["value"]).alias("value"), f["line"].alias("line"), f["snippet"].alias("snippet")))
            clear = lambda rows: F.filter(rows, lambda f: F.contains(f["value"], best) & ~negated_in(f["value"], best, terms.NEGATIONS))
            loose = lambda rows: F.filter(rows, lambda f: F.contains(f["value"], F.get(F.split(best, " "), F.lit(0))))
            return let(lower, lambda rows: F.coalesce(_place_of(clear(rows)), _place_of(loose(rows)), _first_line()))

        return let(let(best, place_of), lambda place: signal(rule.score(config), rule.metadata["confidence"], rule.description, place["line"], place["snippet"]))

    enough = lambda s: (F.size(s["strong"]) + F.size(s["weak"]) >= match.get("min_hint_count", 2)) & ((F.size(s["strong"]) > 0) if match.get("require_strong") else (F.size(s["strong"]) + F.size(s["weak"]) > 0))

    def found(present: Column) -> Column:
        text = F.struct(low.alias("low"), lines_of(low).alias("lines"))
        wanted = let(text, lambda t: F.struct(*[F.filter(strings(h), lambda x: F.array_contains(present, x) & used(t, x)).alias(n) for n, h in (("strong", strong), ("weak", weak))]))
        return F.transform(F.filter(F.array(wanted), enough), report)

    present = let(low, lambda t: F.filter(strings([*strong, *weak]), lambda h: F.contains(t, h)))
    return let(present, lambda p: F.when(F.size(p) > 0, found(p)).otherwise(no_signals()))


def keyword_in_text(rule: Rule, config: Config) -> Column:
    """One signal for the first phrase that occurs.  Without ``first_match_only`` there is none, which callers rely on."""
    hints = rule.match.get("hints", [])
    if not hints or not rule.match.get("first_match_only", True):
        return no_signals()
    first = let(F.lower(F.col("raw_text")), lambda low: F.get(F.filter(strings(hints), lambda h: F.contains(low, h)), F.lit(0)))
    place = lambda hint: F.coalesce(_place_of(F.filter(F.col("fields"), lambda f: F.contains(F.lower(f["value"]), F.get(F.split(F.trim(hint), " "), F.lit(0))))), _first_line())
    found = F.filter(F.array(let(first, lambda h: F.when(h.isNotNull(), place(h)))), lambda p: p.isNotNull())
    return F.transform(found, lambda p: signal(rule.score(config), rule.metadata["confidence"], rule.description, p["line"], p["snippet"]))


def frontmatter_check(rule: Rule, config: Config) -> Column:
    """One signal if the front matter has a path, and something at it."""
    path = rule.match["path"]
    filled = lambda p: (p["path"] == path) & (~p["empty"] if rule.match.get("empty_check", True) else F.lit(True))
    found = F.coalesce(F.exists(F.col("fm.paths"), filled), F.lit(False))
    place = F.coalesce(_with_word(path.split(".")[-1]), _first_line())
    return one(found, signal(rule.score(config), rule.metadata["confidence"], rule.description, place["line"], place["snippet"]))


def remote_reference_scan(rule: Rule, config: Config) -> Column:
    """One signal for unsafe schemes, plain http, shortened links and phrases that fetch and apply."""
    raw, base = F.col("raw_text"), rule.score(config)
    mark = lambda score, label, line, snippet: F.struct(F.lit(score).alias("score"), label.alias("label"), line.cast("int").alias("line"), snippet.alias("snippet"))
    at = lambda line: F.concat(F.lit(" at line "), line.cast("string"))
    # URLs hold no white space, so none goes over a line's end
    numbered = F.transform(F.split(raw, "\n"), lambda line, i: F.struct(line.alias("text"), (i + 1).alias("line")))

    def uris(pattern: str) -> Column:
        """Each URI at its first place; the array of places is in order of lines, so the least place is the first."""
        lines = F.filter(numbered, lambda x: F.contains(x["text"], F.lit(":")))
        found = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(pattern), F.lit(0)), lambda u: F.struct(net.clean_url(u).alias("url"), x["line"].alias("line")))))
        return let(found, lambda all_of: let(F.transform(all_of, lambda x: x["url"]), lambda urls: F.filter(all_of, lambda x, i: F.array_position(urls, x["url"]) == i + 1)))

    unsafe = F.transform(uris(net.UNSAFE_URI), lambda x: mark(72, F.concat(F.lit("unsafe scheme '"), F.lower(F.substring_index(x["url"], ":", 1)), F.lit(":'"), at(x["line"])), x["line"], x["url"]))
    web = uris(net.URL)
    plain = F.filter(web, lambda x: F.startswith(F.lower(x["url"]), F.lit("http://")) & ~net.is_local_host(net.host_of(x["url"])))
    insecure = F.transform(plain, lambda x: mark(base + 8, F.concat(F.lit("insecure http:// to '"), net.host_of(x["url"]), F.lit("'"), at(x["line"])), x["line"], x["url"]))
    short = F.filter(web, lambda x: F.startswith(F.lower(x["url"]), F.lit("https://")) & net.host_of(x["url"]).isin(*terms.SHORTENERS))
    shortened = F.transform(short, lambda x: mark(68, F.concat(F.lit("URL shortener '"), net.host_of(x["url"]), F.lit("'"), at(x["line"])), x["line"], x["url"]))
    low = F.lower(raw)
    present = let(low, lambda t: F.filter(strings(terms.FETCH_PHRASES), lambda h: F.contains(t, h)))
    placed = F.transform(present, lambda h: F.struct(h.alias("hint"), F.size(F.split(F.substring(raw, F.lit(1), F.instr(low, h) - 1), "\n")).alias("line")))
    orders = F.transform(placed, lambda x: mark(74, F.concat(F.lit("fetch-and-apply language '"), x["hint"], F.lit("'"), at(x["line"])), x["line"], F.coalesce(strip(F.get(lines_of(raw), x["line"] - 1)), x["hint"])))
    marks = F.array(F.concat(unsafe, insecure, shortened, orders))
    enough = F.filter(marks, lambda m: F.size(m) >= F.greatest(F.lit(1), F.lit(rule.match.get("min_signals", 1))))

    def report(m: Column) -> Column:
        text = F.concat(F.lit(f"{rule.description} Detected: "), preview(F.transform(m, lambda x: x["label"])), F.lit("."))
        first = F.element_at(m, 1)
        return signal(F.array_max(F.transform(m, lambda x: x["score"])), rule.metadata["confidence"], text, first["line"], F.substring(first["snippet"], 1, terms.SNIPPET))

    triggers = [*(f"{x}:" for x in ("data", "javascript", "vbscript", "ftp", "file", "gopher", "telnet", "ldap")), "http://", "https://", *terms.FETCH_PHRASES]
    triggered = let(low, lambda t: F.exists(strings(triggers), lambda x: F.contains(t, x)))
    return F.when(triggered, F.transform(enough, report)).otherwise(no_signals())

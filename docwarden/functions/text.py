"""Text expressions with the semantics of Python strings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE_ENDS = r"\R|[\x1c-\x1e]"
_BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: within array functions every mention is computed anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines of a text as splitlines() gives them; the end of the last line makes no line of its own."""
    return let(F.split(text, _LINE_ENDS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def has_words(text: Column, n: int) -> Column:
    """Whether a text has n words or more."""
    word = r"[^\s\x1c-\x1f]"
    return F.lit(True) if n < 1 else text.rlike(rf"(?U)(?:{word}+{_BLANK}+){{{n - 1}}}{word}")


def java_quote(text: str) -> str:
    """A literal within a Java pattern, readable by Python too."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def any_of(terms: Iterable[str]) -> str:
    """Pattern of any of the terms."""
    return "(?:" + "|".join(java_quote(t) for t in terms) + ")"


def strings(values: Sequence[str]) -> Column:
    """Literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


#: characters that are counted at once, of which each takes some 60 bytes
_COUNTED = 1 << 19


def entropies(texts: Sequence[str]) -> list[float]:
    """Shannon entropy of the characters of each text in bits, many texts at once."""
    out: list[float] = []
    begin = held = 0
    for end, text in enumerate(texts):
        if held and held + len(text) > _COUNTED:
            out += _entropies(texts[begin:end])
            begin, held = end, 0
        held += len(text)
    return out + _entropies(texts[begin:])


def _entropies(texts: Sequence[str]) -> list[float]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    pair, times = np.unique(owner << 21 | points, return_counts=True)
    share = times / np.maximum(1, sizes)[pair >> 21]
    return (np.bincount(pair >> 21, weights=-share * np.log2(share), minlength=len(texts)) + 0.0).tolist()


def negated_in(line: Column, hint: Column, negations: Sequence[str]) -> Column:
    """Whether a negation is among the 30 characters before the hint's first occurrence in a lower-case line."""

    def of(window: Column) -> Column:
        found = F.lit(False)
        for n in negations:
            found = found | F.contains(window, F.lit(n))
        return found

    return let(let(F.instr(line, hint), lambda at: F.substring(line, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30)))), of)


def first_of(items: Column, default: Column) -> Column:
    """First element of an array, or the default."""
    return F.when(F.size(items) > 0, F.element_at(items, 1)).otherwise(default)


def preview(labels: Column, n: int = 5, separator: str = "; ") -> Column:
    """The first labels and how many more there are."""
    more = F.size(labels) - n
    return F.concat(F.array_join(F.slice(labels, 1, n), separator), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))


def code(point: int) -> str:
    """A code point in a Java pattern's character class."""
    return f"\\x{{{point:X}}}"

"""Toxic clauses by a weighted finite-state grammar.

A text is cut into clauses, and the words of a clause are mapped to classes:
insult, threats, persons, being, intent, negation, reporting verbs and so on.
Five transducers are composed into one table: the negation machine turns a
negated insult or threat ("not an idiot") into a harmless symbol, the reported
machine marks what stands after somebody else's reporting verb, the target
machine aims an insult that is said of a person ("you idiot", "they are all
idiots"), and the insult and threat machines weigh what is left; a threat needs
an intent ("I will", or a command) and a person.  A clause's score is the sum of
its arc weights.

A clause that reaches the threshold makes its document toxic.  An insult that is
aimed at nobody ("the stupid door") stays at half of it, so no isolated word
decides; but a document is also toxic if its matched clauses together reach the
threshold and make at least ``DENSITY`` of it a word, so abuse in pieces counts.

The insult lexicon has a fixed part and one learned from labelled documents: word
beginnings that are found in many different contexts of toxic documents and in
hardly any of the others, weighted by their log odds.  Contexts (the words on
both sides) are counted rather than documents, so the words of a text that is
copied many times don't pass.

Scale: fitting reads a bounded sample of labelled rows (``sample_rows``, chosen by
a hash of the id).  Scoring is one pass without a shuffle.  Words are looked up
by their first three bytes and then by hashes, a whole batch at a time, and only
clauses with a word of the lexicon become Python strings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.base import cut, doc_columns, lean, unwrapped, whole_rows
from docwarden.llm.textkernels import string_parts
from docwarden.llm.transducers import Transducer, compose

SAMPLE_ROWS = 12_000
THRESHOLD = 1.0
DENSITY = 0.005
#: a learned beginning has so many letters; longer words are known by theirs
LEAST_STEM, LONGEST_STEM = 3, 14
#: log odds at which a learned word weighs as much as a fixed one
FULL_ODDS = math.log(100)
_SLICE_BYTES = 1 << 20

_WORDS = {
    "INSULT": """idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown clowns
        imbécile connard salaud abruti idiote crétin dumm dummkopf arschloch trottel abschaum estúpido imbécil cabrón
        inútil gilipollas""",
    "STRONG": "kill murder strangle stab tuer étrangler töten ermorden erwürgen matar asesinar",
    "SOFT": "hurt destroy beat shoot frapper schlagen golpear",
    "YOU": "you u ya tu toi vous du dich dir ihr tú ti usted ustedes vosotros",
    "THEY": "he she they them him her il elle ils elles er sie él ella ellos ellas",
    "SELF": "yourself yourselves",
    "BEING": "are is am was were be es est sont êtes bist ist sind seid son",
    "IT_IS": "you're he's she's they're eres",
    "VERY": "such so very really total complete absolute utter damn just quite all both tellement vraiment sehr echt tan muy",
    "FIRST": "i we i'm we're ich wir je nous yo nosotros",
    "WILL": "will shall gonna going would werde werden vais allons voy vamos",
    "INTENT": "i'll we'll i'd",
    "HARM": "up dead death bloody tot mort muerte",
    "LIKE": "like comme wie como",
    "NEGATION": "not never no isn't aren't wasn't weren't don't won't ne pas jamais nicht kein keine keinen nie nunca ni sin",
    "ARTICLE": "a an the un une le la ein eine einen der die das una el",
    "REPORT": "said says called calls wrote claimed quoted reported dit disait appelé sagte nannte schrieb dijo llamó escribió",
}
_CLASS_OF = {word: name for name, words in _WORDS.items() for word in words.split()}
_HOSTILE = ("INSULT", "STRONG", "SOFT")
SYMBOLS = ["OTHER", *_WORDS, "END"]
#: weight of an insult that is aimed at nobody
BARE = 0.5


def grammar() -> tuple[list[list[tuple[int, float]]], list[str]]:
    """The composed machine.  Each clause is closed by END, which returns every part to its start."""
    negation = Transducer("plain")
    negation.arc("plain", "NEGATION", "negated")
    negation.arc("negated", ["NEGATION", "ARTICLE", "VERY", "BEING"], "negated")
    for symbol in _HOSTILE:
        negation.arc("negated", symbol, "plain", f"NO_{symbol}")
    negation.rest["negated"] = "plain"

    reported = Transducer("direct")
    reported.arc("direct", ["FIRST", "INTENT"], "own")
    reported.arc("direct", "REPORT", "reported")
    # what the speaker says to have said is not somebody else's
    reported.arc("own", "REPORT", "own")
    for symbol in _HOSTILE:
        reported.arc("reported", symbol, "reported", f"SAID_{symbol}")
    for state in ("own", "reported"):
        reported.arc(state, "END", "direct")

    target = Transducer("far")
    for state in ("far", "you", "they", "is", "fading"):
        target.arc(state, "YOU", "you")
        target.arc(state, "THEY", "they")
        target.arc(state, "IT_IS", "is")
        target.arc(state, "END", "far")
    for state in ("you", "they"):
        target.arc(state, ["BEING"], "is")
        target.arc(state, "VERY", state)
        target.rest[state] = "far"
    target.arc("is", ["ARTICLE", "VERY", "NEGATION", "BEING"], "is")
    target.rest |= {"is": "fading", "fading": "far"}
    for state in ("you", "is", "fading"):
        target.arc(state, "INSULT", "is", "AIMED_INSULT")

    insult = Transducer("quiet")
    insult.arc("quiet", "AIMED_INSULT", "quiet", weight=1.5)
    insult.arc("quiet", "SAID_INSULT", "quiet", weight=0.1)
    for state in ("quiet", "named", "compared"):
        insult.arc(state, "INSULT", "named", weight=BARE)
    insult.arc("named", "LIKE", "compared")
    insult.arc("compared", "YOU", "quiet", weight=1.0)
    insult.arc("compared", "THEY", "quiet", weight=1.0)
    insult.rest |= {"named": "quiet", "compared": "quiet"}

    threat = Transducer("calm")
    for state in ("calm", "first", "intent", "strong", "meant_strong", "soft", "meant_soft", "hit"):
        meant = state in ("intent", "meant_strong", "meant_soft", "hit")
        threat.arc(state, "INTENT", "intent")
        threat.arc(state, "STRONG", "meant_strong" if meant else "strong", weight=0.2)
        threat.arc(state, "SOFT", "meant_soft" if meant else "soft", weight=0.1)
        threat.arc(state, "END", "calm")
    threat.arc("calm", "FIRST", "first")
    threat.arc("first", ["FIRST", "VERY", "NEGATION", "BEING"], "first")
    threat.arc("first", "WILL", "intent")
    threat.rest["first"] = "calm"
    for person in ("YOU", "THEY", "SELF"):
        threat.arc("strong", person, "calm", weight=1.0 if person == "SELF" else 0.6)
        threat.arc("meant_strong", person, "intent", weight=1.2)
        threat.arc("soft", person, "calm", weight=0.3)
        threat.arc("meant_soft", person, "hit", weight=0.6)
    threat.arc("hit", "HARM", "intent", weight=0.5)
    for state, back in (("strong", "calm"), ("soft", "calm"), ("meant_strong", "intent"), ("meant_soft", "intent"), ("hit", "intent")):
        threat.arc(state, ["ARTICLE", "VERY"], state)
        threat.rest[state] = back
    return compose([negation, reported, target, insult, threat], SYMBOLS)


_TABLE, _ORDER = grammar()
_COLUMN = {name: i for i, name in enumerate(_ORDER)}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: a sentence ends at its sign or the line's end; commas don't end a clause, as reported speech goes across them
_CLAUSE_END = np.isin(np.arange(256), list(b".!?;\n\r"))
_LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])
_WORD_BYTE = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash_of(raw: bytes) -> int:
    h = 0
    for byte in raw:
        h = (h * int(_BASE) + byte + 1) & ((1 << 64) - 1)
    return h


class Lexicon:
    """Fixed insults and threats, and learned stems with their weights."""

    def __init__(self, stems: Mapping[str, float] | None = None):
        self.stems = dict(stems or {})
        self._lengths = sorted({len(s) for s in self.stems}, reverse=True)
        whole = [w.encode() for w, c in _CLASS_OF.items() if c in _HOSTILE]
        starts = [s.encode() for s in self.stems]
        self._begins = np.zeros(1 << 24, dtype=bool)
        for raw in (*whole, *starts):
            self._begins[raw[0] | raw[1] << 8 | raw[2] << 16] = True
        self._whole, self._starts = self._by_length(whole), self._by_length(starts)

    @staticmethod
    def _by_length(words: list[bytes]) -> dict[int, np.ndarray]:
        return {n: np.array([_hash_of(w) for w in words if len(w) == n], dtype=np.uint64) for n in {len(w) for w in words}}

    def class_of(self, word: str) -> tuple[str, float]:
        """Class of a word and the factor of its weight."""
        found = _CLASS_OF.get(word)
        if found:
            return found, 1.0
        for n in self._lengths:
            if word[:n] in self.stems:
                return "INSULT", self.stems[word[:n]]
        return "OTHER", 1.0

    def clause_score(self, clause: str) -> tuple[float, float]:
        """Score and sum of the weights along the machine's path over the words of one clause in lower case.

        However many insults of the clause are aimed at nobody, its score has one of them at most.
        """
        state, aimed, bare = 0, 0.0, 0.0
        for match in _WORD.finditer(clause):
            name, factor = self.class_of(match.group())
            state, weight = _TABLE[state][_COLUMN[name]]
            if name == "INSULT" and weight == BARE:
                bare += weight * factor
            else:
                aimed += weight * factor
        return round(aimed + min(bare, BARE), 6), round(aimed + bare, 6)

    def _triggers(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where a hostile word may begin; ``first``: the bytes that begin a document.

        A byte of a longer character may be a letter or a sign, so it counts as both.
        """
        padded = np.concatenate((data, np.zeros(max(3, *self._whole, *self._starts, 0) + 1, np.uint8)))
        begins = _LETTER[data]
        before = data[:-1]
        begins[1:] &= ~(_LETTER[before] & (before < 128))
        begins[first[first < len(data)]] = _LETTER[data[first[first < len(data)]]]
        at = np.flatnonzero(begins)
        at = at[self._begins[padded[at].astype(np.int32) | padded[at + 1].astype(np.int32) << 8 | padded[at + 2].astype(np.int32) << 16]]
        hit = np.zeros(len(at), dtype=bool)
        h = np.zeros(len(at), dtype=np.uint64)
        for n in range(1, max((*self._whole, *self._starts, 0)) + 1):
            h = h * _BASE + padded[at + (n - 1)] + np.uint64(1)
            if n in self._starts:
                hit |= np.isin(h, self._starts[n])
            if n in self._whole:
                after = padded[at + n]
                hit |= np.isin(h, self._whole[n]) & ((after >= 128) | ~_LETTER[after])
        return at[hit]

    def matches(self, column: pa.Array) -> Iterator[tuple[int, float, float, str, int]]:
        """(row, score, sum, clause, words of the document) of every clause that scores, in order; clauses are in lower case."""
        data, bounds = string_parts(pc.utf8_lower(column.cast(pa.large_string())))
        row, n = 0, len(bounds) - 1
        while row < n:
            stop = min(n, max(row + 1, int(np.searchsorted(bounds, bounds[row] + _SLICE_BYTES, side="right")) - 1))
            part, edges = data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
            triggers = self._triggers(part, edges[:-1])
            if len(triggers):
                inside = _WORD_BYTE[part]
                inside[1:] &= ~_WORD_BYTE[part[:-1]]
                begins = edges[edges < len(part)]
                inside[begins] = _WORD_BYTE[part[begins]]
                words = np.concatenate(([0], np.cumsum(inside)))
                ends = np.flatnonzero(_CLAUSE_END[part])
                doc = np.searchsorted(edges, triggers, side="right") - 1
                place = np.searchsorted(ends, triggers)
                around = np.concatenate(([-1], ends, [len(part)]))
                lo, hi = np.maximum(around[place] + 1, edges[doc]), np.minimum(around[place + 1], edges[doc + 1])
                new = np.concatenate(([True], lo[1:] != lo[:-1]))
                for d, a, b in zip(doc[new].tolist(), lo[new].tolist(), hi[new].tolist()):
                    clause = part[a:b].tobytes().decode("utf-8")
                    score, total = self.clause_score(clause)
                    if total:
                        yield row + d, score, total, clause.strip(), int(words[edges[d + 1]] - words[edges[d]])
            row = stop

    def verdicts(self, column: pa.Array, threshold: float) -> Iterator[tuple[int, float, float, int, str]]:
        """(row, greatest clause score, total, clauses, worst clause) of the toxic documents."""
        held: list[tuple[int, float, float, str, int]] = []

        def close() -> Iterator[tuple[int, float, float, int, str]]:
            if held:
                total = round(sum(x[2] for x in held), 6)
                worst = max(held, key=lambda x: (x[1], x[3]))
                if worst[1] >= threshold or total >= max(threshold, DENSITY * held[0][4]):
                    yield held[0][0], worst[1], total, len(held), worst[3]
                held.clear()

        for match in self.matches(column):
            if held and held[0][0] != match[0]:
                yield from close()
            held.append(match)
        yield from close()


def learn_stems(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Word beginnings that mark toxic documents, with their weights, from at most ``sample_rows`` labelled rows.

    A third of the sample is toxic where there are enough toxic rows.  A
    beginning is taken if its contexts are so often toxic that chance would give
    that to less than a hundredth of all beginnings, and if at most a fiftieth of
    its contexts are not toxic; of those the shortest is taken, lengthened as
    long as it keeps 19 of 20 contexts.  Its weight is the log of the odds of its
    contexts over those of all, as a share of ``FULL_ODDS``, and 1 at most.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").distinct()
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # a bound on the hash, from each class's own count, keeps the window small
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return {}
    bounds = {c: math.ceil(min(1.0, 20 * sample_rows / n) * 1_000_000) for c, n in counts.items()}
    near = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, bounds.get(1, 0)).otherwise(bounds.get(0, 0)))
    wanted = near.withColumn("place", place).filter((F.col("place") <= F.when(F.col("toxic") == 1, sample_rows // 3).otherwise(sample_rows - sample_rows // 3))).select("doc_id", "toxic")
    rows = doc_columns(docs).filter("text is not null").join(F.broadcast(wanted), "doc_id")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    triples = rows.select("toxic", words.alias("w")).select("toxic", F.explode(F.when(F.size("w") > 0, F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.col("w")).alias("last"), F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), F.array(F.lit(""))).alias("next")))).alias("t"))
    contexts = triples.filter("t.word is not null").select(F.col("t.word").alias("word"), F.xxhash64("t.last", "t.next").alias("context"), "toxic").distinct()
    per_word = contexts.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    per_word = cut(per_word)
    total = per_word.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not total["bad"] or not total["good"]:
        return {}
    stems = per_word.filter(F.length("word") >= LEAST_STEM).select(F.explode(F.transform(F.sequence(F.lit(LEAST_STEM), F.least(F.length("word"), F.lit(LONGEST_STEM))), lambda n: F.substring("word", F.lit(1), n))).alias("stem"), "bad", "good")
    counted = stems.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    chance = total["bad"] / (total["bad"] + total["good"])
    number = max(1, stems.select("stem").distinct().count())
    least = math.ceil(math.log(0.01 / number) / math.log(chance))
    passed = counted.filter((F.col("bad") >= least) & (F.col("good") * 49 <= F.col("bad"))).collect()
    found = {r["stem"]: r["bad"] for r in passed if len(r["stem"].encode()) >= 3}
    good = {r["stem"]: r["good"] for r in passed}
    prior = total["bad"] / total["good"]
    out = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if any(stem[:n] in found for n in range(LEAST_STEM, len(stem))):
            continue
        while True:
            longer = max((s for s in found if len(s) == len(stem) + 1 and s.startswith(stem)), key=lambda s: (found[s], s), default=None)
            if longer is None or found[longer] * 20 < found[stem] * 19:
                break
            stem = longer
        odds = math.log((found[stem] + 0.5) / (good[stem] + 0.5) / prior)
        out[stem] = round(min(1.0, max(0.0, odds / FULL_ODDS)), 3)
    return out


def _scorer(stems: dict[str, float], threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            rows = list(lexicon.verdicts(batch["text"], threshold))
            if rows:
                row, *columns = zip(*rows)
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row)), *arrays], names=["doc_id", "score", "total", "clauses", "worst_clause"])

    return score


def toxic_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (doc_id, score, total, clauses, worst_clause) of the documents that the grammar rejects.

    ``score`` is the greatest clause score, ``total`` the sum and ``clauses`` the
    number of clauses that score at all; a document is rejected if its score
    reaches the threshold, or its total does and is ``DENSITY`` times its words at
    least.  ``worst_clause`` is in lower case (of ties the greatest string).
    Defined cases: null and empty texts are not toxic; a null id is scored as any
    other; repeated rows are each reported, and so are rows that repeat an id
    with other texts, each by its own; without usable labels the fixed lexicon
    alone is used; an empty table gives no rows; other columns are not looked at.
    """
    stems = learn_stems(docs, labels, sample_rows=sample_rows)
    return doc_columns(docs).filter("text is not null").mapInArrow(lean(_scorer(stems, threshold)), "doc_id long, score double, total double, clauses long, worst_clause string")


def _sieve(stems: dict[str, float], threshold: float):
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            names, columns = unwrapped(batch)
            keep = np.ones(len(batch), dtype=bool)
            keep[[row for row, *_ in lexicon.verdicts(columns[names.index("text")], threshold)]] = False
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return sieve


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that :func:`toxic_documents` doesn't report; all columns stay.

    Defined cases: rows with a null text stay, with a null id too if their text is
    not toxic; repeated rows are judged each by its text; other columns may have
    any names; an empty table stays empty.
    """
    stems = learn_stems(docs, labels, sample_rows=sample_rows)
    return whole_rows(docs).mapInArrow(lean(_sieve(stems, threshold)), docs.schema)

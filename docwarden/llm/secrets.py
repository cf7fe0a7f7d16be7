"""Secret scan: which long tokens look like random keys.

Candidates are runs of at least ``MIN_LENGTH`` characters of the base64
alphabets.  A key may be joined to a prefix, a path or another key, so a run has
several hypotheses: the whole of it, every longest stretch of symbols of one
encoding within it (with and without what stands before any separator in it),
and groups with hyphens between (UUIDs).
A span's encoding is the least that has all its characters, and two questions
are asked.

Is it random?  A battery of tests against uniform symbols of the encoding:
chi-squared of the alphabet, runs about the median and serial correlation.  They
depend on each other, so the least p-value counts three times.  A span that fails
(a counter, a repeated pattern) is no candidate for a discovery.

Could it be ordinary text?  The battery alone can't tell: sixteen letters of a
word often pass for uniform ones.  So the null hypothesis is the corpus's own
text: a model of neighbouring characters without regard to case, fitted on the
runs that are too short to be candidates, and mixed with one of common words, joined by signs and numbers as in names, paths and addresses.  The
case of letters is a matter of how often it changes, so words in capitals and
joined words with capitals inside are ordinary, and numbers without a letter
are never keys.  A span's e-value is its probability under uniform symbols over
that under the mixture, shared among the encodings, and nothing where the
battery fails.  Half of a run's weight is for the whole, a
quarter for what lies between two of its separators (given where they are), an
eighth for all windows where a part could lie and an eighth for joined groups,
each shared equally; and runs are weighted by length, since short ones can't
carry much evidence.  The e-Benjamini-Hochberg rule over the runs bounds the
share of false discoveries whatever their dependence, as far as the model
describes ordinary text.  Of spans that overlap, the one of most evidence that
passes is reported.

Scale: both statistics of the corpus, the counts of neighbours and the histogram
of e-values, are partial sums of fixed size.  No text is shuffled; redaction reads
the texts again and repeats the decision.  A run has as many hypotheses as
separators; all they are asked are differences of running sums (whole numbers, so
they don't depend on what else is in a batch), so a run costs no more than its
length times a logarithm, however many there are.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.base import doc_columns, lean, replaced, unwrapped, whole_rows, with_text
from docwarden.llm.textkernels import runs

MIN_LENGTH = 16
FALSE_DISCOVERY = 0.01
LEAST_RANDOM = 1e-4
#: shares of letters at which the case changes: in plain words, names and names of several words
CASE_CHANGES = (0.01, 0.06, 0.15)
MASK = "[SECRET]"
_BINS_PER_UNIT = 8
#: log probabilities are summed as multiples of 1 / _UNITS
_UNITS = 1 << 30
#: spans up to this length are counted by themselves, longer ones from running sums of their run
_COUNTED = 4096

_ALPHABET = np.zeros(256, dtype=bool)
_ALPHABET[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True

ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
_NAMES = list(ENCODINGS)
_SIZES = np.array([len(x) for x in ENCODINGS.values()])
#: bit e is set where the byte isn't a symbol of encoding e
_OUTSIDE = np.full(256, (1 << len(_NAMES)) - 1, dtype=np.int64)
for _e, _symbols in enumerate(ENCODINGS.values()):
    for _c in _symbols:
        _OUTSIDE[ord(_c)] &= ~(1 << _e)
_JOINED = ("hex", "HEX", "BASE36")
_JOINT = ord("-")
_GROUP = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_IS_SEPARATOR = np.isin(np.arange(256), list(b"+/_-"))
#: place of each byte in each encoding, -1 where it has none
_PLACE = np.full((len(_NAMES), 256), -1, dtype=np.int64)
for _e, _symbols in enumerate(ENCODINGS.values()):
    _PLACE[_e, [ord(_c) for _c in _symbols]] = np.arange(len(_symbols))
_SEPARATORS = {"base64": list(b"/"), "base64url": list(b"-_"), "mixed": list(b"/-_")}


#: folded letters, digits and signs have a code each; the last one stands for all that is outside a run
_CODE = np.full(256, 40, dtype=np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789+/_-"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i
_OUT = 40
_SEPARATOR_CODES = [_CODE[ord(c)] for c in "+/_-"]
_IS_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])
_IS_UPPER = np.array([i < 128 and chr(i).isupper() for i in range(256)])


@dataclass(frozen=True)
class Background:
    """Log probabilities of a character after another one in the corpus (row: the one before), and the level that makes a discovery."""

    log_pair: np.ndarray
    mean_length: float
    level: float = math.inf


def pair_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from counts of pairs (41 x 40); each row has ten counts more, shared as all characters are."""
    single = counts.sum(0) + 1.0
    single /= single.sum()
    smooth = counts + 10.0 * single
    return np.log(smooth / smooth.sum(1, keepdims=True))


#: common words and parts of names, for what the corpus doesn't say
_COMMON = """the of and to in is you that it he was for on are as with his they at be this have from or one had by word but
    not what all were we when your can said there use an each which she do how their if will up other about out many then
    them these so some her would make like him into time has look two more write go see number no way could people my than
    first water been call who its now find long down day did get come made may part over new sound take only little work
    know place year live back give most very after thing our just name good sentence man think say great where help through
    much before line right too mean old any same tell follow came want show also around form three small set put end does
    another well large must big even such because turn here why ask went men read need land different home move try kind
    hand picture again change off play spell air away animal house point page letter mother answer found study still learn
    should world high every near add food between own below country plant last school father keep tree never start city
    earth light thought head under story saw left few while along might close something seem next hard open example begin
    life always those both paper together got group often run important until children side feet car mile night walk white
    sea began grow took river four carry state once book hear stop without second later miss idea enough eat face watch far
    really almost let above girl sometimes mountain cut young talk soon list song being leave family music color
    international business customer service center professional development environment environmental protection question
    frequently asked terms conditions apply information technology government university education management organization
    department production performance application configuration documentation implementation representation administration
    community experience available following company product project program system security access account address
    abstract array async base boolean buffer builder button cache callback char class client code command comment component
    config connection container content context control controller count create current cursor data database date default
    delete description detail device dialog dictionary directory document download element email enable entry error event
    exception execute export factory field file filter find flag folder format frame function generator get global handle
    handler hash header height hidden html http https icon identifier image import index initialize input insert instance
    integer interface internal item iterator json key label language layout length level library link listener load local
    location lock login main manager map mask match memory menu message method mode model module monitor mouse name network
    node null object observer option order output package panel param parent parse password path pattern pixel plugin pointer
    policy port position post prefix print private process profile properties protocol provider proxy public query queue
    random range record reference register remove render request reset resource response result return role root route
    schema scope script scroll search select sequence server session setting shadow shape signal single singleton size
    source stack static status store stream string structure style submit suffix switch symbol sync table target task
    template test text theme thread threshold title toggle token tool top total trace transaction transform tree type
    unique update upload url user util valid validate value variable vector version view visible web widget width window
    wrapper xml"""
_JOINING = {"/": 0.05, "-": 0.05, "_": 0.05, "+": 0.005}


def common_model() -> np.ndarray:
    """Log probabilities of the same kind for common words joined by each other, signs and digits."""
    counts = np.zeros((41, 40))
    for word in _COMMON.split():
        code = [int(_CODE[ord(c)]) for c in word]
        counts[_OUT, code[0]] += 1
        for a, b in zip(code, code[1:]):
            counts[a, b] += 1
        counts[code[-1], :26] += counts[_OUT, :26] / max(1.0, counts[_OUT, :26].sum()) * 0.3
    model = counts + 0.2
    model[:, 26:] = 0
    model /= model.sum(1, keepdims=True)
    digits, signs = slice(26, 36), [int(_CODE[ord(c)]) for c in _JOINING]
    mixed = np.zeros((41, 40))
    letters = [*range(26), _OUT, *signs]
    joining = np.array(list(_JOINING.values()))
    first = model[_OUT]
    mixed[letters] = model[letters] * (1 - 0.05 - joining.sum())
    mixed[signs] = first * (1 - 0.25 - joining.sum())
    mixed[letters, digits] = 0.05 / 10
    mixed[signs, digits] = 0.25 / 10
    mixed[digits] = first * (1 - 0.75 - joining.sum())
    mixed[digits, digits] = 0.75 / 10
    mixed[:, signs] = joining
    return np.log(mixed / mixed.sum(1, keepdims=True))


_COMMON_PAIR = common_model()


def case_costs(letters: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """Log probability of a sequence of capitals with so many changes between letters; ordinary words change rarely."""
    steps = np.maximum(letters - 1, 0)
    of_rate = [changes * math.log(p) + (steps - changes) * math.log1p(-p) for p in CASE_CHANGES]
    return np.where(letters > 0, np.logaddexp.reduce(of_rate, axis=0) - math.log(2 * len(CASE_CHANGES)), 0.0)


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularized incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, front * h)


class _Symbols:
    """Running counts over symbols of an alphabet of k, of which the battery of any span is read."""

    def __init__(self, values: np.ndarray, k: int):
        n, self.k = len(values), k
        high = values * 2 >= k
        centred = values * 2 - (k - 1)
        self.high = np.concatenate(([0], np.cumsum(high)))
        # entry i: changes, and products of neighbours, up to and with the pair (i - 1, i)
        self.changes = np.concatenate(([0], np.cumsum(high[1:] != high[:-1])))
        self.products = np.concatenate(([0], np.cumsum(centred[1:] * centred[:-1])))
        self.places = np.sort(values * (n + 1) + np.arange(n))
        self.firsts = np.arange(k) * (n + 1)

    def battery(self, lo: int, hi: int) -> tuple[float, float, float, float]:
        n, k = hi - lo, self.k
        # neighbouring symbols share a cell where there would be fewer than two a cell
        cells = max(2, min(k, n // 2))
        cell = np.arange(k) * cells // k
        each = np.searchsorted(self.places, self.firsts + hi) - np.searchsorted(self.places, self.firsts + lo)
        counts = np.bincount(cell, weights=each, minlength=cells)
        shares = np.bincount(cell, minlength=cells) / k
        chi = float(np.sum((counts - n * shares) ** 2 / (n * shares)))
        uniform = _gamma_tail((cells - 1) / 2, chi / 2)
        n1 = int(self.high[hi] - self.high[lo])
        n2 = n - n1
        if n1 and n2:
            mean = 2 * n1 * n2 / n + 1
            spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
            found = 1 + int(self.changes[hi - 1] - self.changes[lo])
            p_runs = math.erfc(max(0.0, abs(found - mean) - 0.5) / spread / math.sqrt(2))
        else:
            p_runs = 2.0 ** (1 - n)
        variance = (k * k - 1) / 12
        serial = float(self.products[hi - 1] - self.products[lo]) / 4 / (variance * math.sqrt(n - 1))
        p_serial = math.erfc(abs(serial) / math.sqrt(2))
        return uniform, p_runs, p_serial, min(1.0, 3 * min(uniform, p_runs, p_serial))


def battery(token: str, encoding: str) -> tuple[float, float, float, float]:
    """p-values of uniformity, runs and serial correlation of the symbols, and of all three (the least, three times)."""
    values = _PLACE[_NAMES.index(encoding), np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
    return _Symbols(values, len(ENCODINGS[encoding])).battery(0, len(values))


def _stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of every longest stretch of true values; the last value is false."""
    change = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _candidates(column: pa.Array, background: Background):
    """Yields (first row, words, run, first byte, last byte + 1, encoding, log e-value, log weighted e-value) over runs of documents; each hypothesis has an entry."""
    models = []
    for log_pair in (background.log_pair, _COMMON_PAIR):
        separators = np.log(np.exp(log_pair[:, _SEPARATOR_CODES]).sum(1))
        logs = (log_pair, separators, np.log1p(-np.exp(separators)), np.log1p(-np.exp(log_pair[:, _CODE[_JOINT]])))
        models.append([np.rint(x * _UNITS).astype(np.int64) for x in logs])

    def running(per_symbol: list[np.ndarray]) -> list[np.ndarray]:
        return [np.concatenate(([0], np.cumsum(x))) for x in per_symbol]

    def mixed(sums: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Log probability of each span under the equal mixture of the models."""
        return np.logaddexp(*((x[hi] - x[lo]) / _UNITS for x in sums)) - math.log(2)

    for first, _, words in runs(column, _ALPHABET.astype(np.uint8), None):
        length = words.end - words.start
        chosen = np.flatnonzero(length >= MIN_LENGTH)
        if not len(chosen):
            continue
        # the bytes of the chosen runs, each followed by one that no encoding has
        size = length[chosen]
        begin = np.cumsum(size + 1) - size - 1
        run_of = np.repeat(np.arange(len(chosen)), size + 1)
        source = np.arange(len(run_of)) - begin[run_of] + words.start[chosen][run_of]
        closing = begin + size
        source[closing] = 0
        data = words.data[source]
        data[closing] = 0
        outside = _OUTSIDE[data]
        code = _CODE[data]
        last = np.concatenate(([_OUT], code[:-1]))
        ordinary = [np.where(data > 0, m[0][last, np.minimum(code, _OUT - 1)], 0) for m in models]
        letter = _IS_LETTER[data]
        letters = np.concatenate(([0], np.cumsum(letter)))
        places = np.flatnonzero(letter)
        upper = _IS_UPPER[data[places]]
        # changes[i]: changes of case up to and with the i-th letter; spans don't cross runs, so neither do they
        changes = np.concatenate(([0, 0], np.cumsum(upper[1:] != upper[:-1])))

        def cased(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """Log probability of the case of the letters in each span."""
            a, b = letters[lo], letters[hi]
            return case_costs(b - a, np.where(b > a, changes[b] - changes[np.minimum(a + 1, len(changes) - 1)], 0))

        # a part between separators is weighed given where the separators are
        separator = _IS_SEPARATOR[data]
        given = running([x - np.where(separator, m[1][last], m[2][last]) for x, m in zip(ordinary, models)])
        edge = separator | (data == 0)
        before = np.concatenate([[True], edge[:-1]])
        breaks_of = np.bincount(run_of[separator], minlength=len(chosen))
        pairs = (breaks_of + 1) * (breaks_of + 2) / 2
        windows = (size - MIN_LENGTH + 1) * (size - MIN_LENGTH + 2) / 2
        parts = []
        for joined, names in ((False, _NAMES), (True, _JOINED)):
            joint = (data == _JOINT) & joined
            bits = np.where(joint, 0, outside)
            sums = running([np.where(joint, 0, x - m[3][last]) for x, m in zip(ordinary, models)] if joined else ordinary)
            strange = [np.flatnonzero(bits >> e & 1) for e in range(len(_NAMES))]
            for name in names:
                e = _NAMES.index(name)
                if name == "decimal":
                    continue
                lo, hi = _stretches((bits >> e & 1) == 0)
                if joined:
                    # only whole groups, from the first that begins in the stretch to the last that ends there
                    group_lo, group_hi = _stretches(_GROUP[data])
                    first_at, last_at = np.searchsorted(group_lo, lo), np.searchsorted(group_hi, hi, side="right") - 1
                    some = first_at <= last_at
                    lo, hi = group_lo[first_at[some]], group_hi[last_at[some]]
                    joints = np.concatenate([[0], np.cumsum(joint)])
                    symbols = hi - lo - (joints[hi] - joints[lo])
                else:
                    if name in _SEPARATORS:
                        # a path or prefix of the same alphabet may lie before the key
                        breaks = np.flatnonzero(np.isin(data, _SEPARATORS[name]))
                        of = np.searchsorted(lo, breaks, side="right") - 1
                        within = (of >= 0) & (breaks < hi[of])
                        lo, hi = np.concatenate([lo, breaks[within] + 1]), np.concatenate([hi, hi[of[within]]])
                    symbols = hi - lo
                long = symbols >= MIN_LENGTH
                if joined:
                    long &= hi - lo > symbols
                lo, hi, symbols = lo[long], hi[long], symbols[long]
                if not len(lo):
                    continue
                missing = sum((np.searchsorted(x, hi) > np.searchsorted(x, lo)).astype(np.int64) << i for i, x in enumerate(strange))
                least = np.argmax((missing[:, None] >> np.arange(len(_NAMES)) & 1) == 0, axis=1) == e
                if joined and name == "BASE36":
                    # groups of lesser encodings that aren't joined themselves stay here
                    least = (missing >> _NAMES.index("hex") & missing >> _NAMES.index("HEX") & 1) == 1
                log_case = cased(lo, hi)
                log_e = -symbols * np.log(_SIZES[e]) - mixed(sums, lo, hi) - log_case - math.log(len(_JOINED if joined else _NAMES))
                run = run_of[lo]
                whole = (hi - lo == size[run]) & (not joined)
                weighted = log_e - np.where(whole, math.log(2), np.log(8 * windows[run]))
                if not joined:
                    log_given = -symbols * np.log(_SIZES[e]) - mixed(given, lo, hi) - log_case - math.log(len(_NAMES))
                    bounded = before[lo] & edge[hi]
                    weighted = np.where(bounded, np.maximum(weighted, log_given - np.log(4 * pairs[run])), weighted)
                weighted += np.log(size[run] / background.mean_length)
                at = words.start[chosen][run] - begin[run]
                parts.append([x[least] for x in (run, lo + at, hi + at, np.full(len(lo), e), log_e, weighted)])
        if parts:
            yield first, words, *(np.concatenate(x) for x in zip(*parts))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, tokens, characters = np.zeros(41 * 41, dtype=np.int64), 0, 0
    for batch in batches:
        for _, _, words in runs(batch["text"], _ALPHABET.astype(np.uint8), None):
            code = _CODE[words.data]
            length = words.end - words.start
            long = length >= MIN_LENGTH
            # candidates are not what they are compared with
            inside = np.zeros(len(code) + 1, dtype=np.int8)
            inside[words.start[long]] = 1
            inside[words.end[long]] -= 1
            code = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, _OUT, code)
            last = np.concatenate(([_OUT], code[:-1]))
            begins = words.doc_byte[:-1]
            last[begins[begins < len(code)]] = _OUT
            counts += np.bincount(last * 41 + code, minlength=41 * 41)
            tokens += int(np.sum(long))
            characters += int(length[long].sum())
    pair = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([*pair.tolist(), -1, -2]), pa.array([*counts[pair].tolist(), tokens, characters])], names=["pair", "n"])


def _symbols(data: np.ndarray, start: int, end: int, e: int) -> tuple[np.ndarray, _Symbols]:
    """Places and running counts of the bytes that are symbols of an encoding; joints aren't."""
    values = _PLACE[e, data[start:end]]
    inside = np.flatnonzero(values >= 0)
    return inside + start, _Symbols(values[inside], int(_SIZES[e]))


def _passing(words, run, lo, hi, encoding, weighted, level: float) -> Iterator[tuple[int, float, str, str]]:
    """(hypothesis, p of randomness, token, encoding) of those that reach the level and pass the battery, by run and descending evidence, without overlaps."""
    passed = np.flatnonzero(np.floor(weighted * _BINS_PER_UNIT) / _BINS_PER_UNIT >= level)
    passed = passed[np.lexsort((lo[passed], -weighted[passed], run[passed]))]
    for mine in np.split(passed, np.flatnonzero(np.diff(run[passed])) + 1):
        # starts and ends of those taken, in order
        starts: list[int] = []
        ends: list[int] = []
        counted: dict[int, tuple[np.ndarray, _Symbols]] = {}
        for at in mine.tolist():
            start, end, e = int(lo[at]), int(hi[at]), int(encoding[at])
            place = bisect_right(starts, start)
            if (place and ends[place - 1] > start) or (place < len(starts) and starts[place] < end):
                continue
            if end - start <= _COUNTED:
                where, symbols = _symbols(words.data, start, end, e)
            else:
                if e not in counted:
                    same = mine[encoding[mine] == e]
                    counted[e] = _symbols(words.data, int(lo[same].min()), int(hi[same].max()), e)
                where, symbols = counted[e]
            p = symbols.battery(*np.searchsorted(where, (start, end)).tolist())[3]
            if p >= LEAST_RANDOM:
                starts.insert(place, start)
                ends.insert(place, end)
                yield at, p, words.data[start:end].tobytes().decode("ascii"), _NAMES[e]


def _weigher(background: Background, least: float):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, int] = {}
        for batch in batches:
            for _, words, run, lo, hi, encoding, _, weighted in _candidates(batch["text"], background):
                seen = -1
                # no level is below the least one, so weaker hypotheses need no test
                for at, *_ in _passing(words, run, lo, hi, encoding, weighted, least):
                    if run[at] != seen:
                        seen = run[at]
                        place = int(math.floor(weighted[at] * _BINS_PER_UNIT))
                        bins[place] = bins.get(place, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())], names=["bin", "n"])

    return weigh


def level_of(histogram: Mapping[int, int], tokens: int, false_discovery: float) -> float:
    """Least log e-value of a discovery: the k largest of all tokens' are discoveries where the k-th is at least tokens / (rate * k)."""
    passed, level = 0, math.inf
    for place in sorted(histogram, reverse=True):
        passed += histogram[place]
        if place / _BINS_PER_UNIT >= math.log(tokens / (false_discovery * passed)):
            level = place / _BINS_PER_UNIT
    return level


def background_of(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> Background:
    """Both statistics of all texts: pairs of characters, then the level of the weighted e-BH rule."""
    texts = doc_columns(docs).filter("text is not null").select("text")
    rows = {r["pair"]: r["n"] for r in texts.mapInArrow(lean(_count_pairs), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    tokens, characters = rows.get(-1, 0), rows.get(-2, 0)
    counts = np.array([rows.get(c, 0) for c in range(41 * 41)], dtype=float).reshape(41, 41)[:, :_OUT]
    base = Background(pair_model(counts), characters / tokens if tokens else 1.0)
    if not tokens:
        return base
    found = texts.mapInArrow(lean(_weigher(base, -math.log(false_discovery))), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return Background(base.log_pair, base.mean_length, level_of({r["bin"]: r["n"] for r in found}, tokens, false_discovery))


def _found(column: pa.Array, background: Background):
    """Yields (row, first byte, token, encoding, log e, p of randomness) of each secret; bytes count within the document."""
    for first, words, run, lo, hi, encoding, log_e, weighted in _candidates(column, background):
        for at, p, token, name in _passing(words, run, lo, hi, encoding, weighted, background.level):
            d = int(np.searchsorted(words.doc_byte, lo[at], side="right")) - 1
            yield first + d, int(lo[at] - words.doc_byte[d]), token, name, float(log_e[at]), p


def _reporter(background: Background):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_found(batch["text"], background))
            if rows:
                row, at, token, name, log_e, p = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row)), pa.array(at, pa.int64()), pa.array(token), pa.array(name), pa.array([x / math.log(10) for x in log_e]), pa.array(p)],
                    names=["doc_id", "byte_offset", "token", "encoding", "log10_e", "p_random"],
                )

    return report


def find_secrets(docs: DataFrame, *, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """Rows (doc_id, byte_offset, token, encoding, log10_e, p_random), one for each secret in each document.

    Runs of fewer than 16 characters of the base64 alphabets are not tested: they
    could not carry the evidence that many tokens ask for.  Offsets count UTF-8
    bytes.  Defined cases: null and empty texts have none; a null id is kept as
    null; repeated rows and tokens are all reported, and so are unlike texts of
    one id; an empty table gives no rows; columns besides doc_id and text are not
    looked at.
    """
    background = background_of(docs, false_discovery)
    return doc_columns(docs).filter("text is not null").mapInArrow(lean(_reporter(background)), "doc_id long, byte_offset long, token string, encoding string, log10_e double, p_random double")


def _masker(background: Background):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = unwrapped(batch)
            at = names.index("text")
            spans: dict[int, list[tuple[int, int]]] = {}
            for row, lo, token, *_ in _found(columns[at], background):
                spans.setdefault(row, []).append((lo, lo + len(token)))
            if spans:
                texts: dict[int, str] = {}
                for row, places in spans.items():
                    raw, out, last = columns[at][row].as_py().encode("utf-8"), [], 0
                    for lo, hi in sorted(places):
                        out += [raw[last:lo], MASK.encode()]
                        last = hi
                    texts[row] = b"".join([*out, raw[last:]]).decode("utf-8")
                columns[at] = replaced(columns[at], texts)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mask


def redact_secrets(docs: DataFrame, *, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """The documents with every secret replaced by a mask; all rows and columns stay, ``n_chars`` follows the text.

    Defined cases: null and empty texts stay as they are; rows with a null id,
    repeated rows and unlike texts of one id are each masked; other columns may
    have any names; an empty table stays empty.
    """
    background = background_of(docs, false_discovery)
    return with_text(whole_rows(docs).mapInArrow(lean(_masker(background)), docs.schema), F.col("text"))

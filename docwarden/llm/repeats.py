"""Exact repeated passages by suffix arrays.

A passage of ``min_words`` words (runs of anything but ASCII white space) that
occurs more than once is a repeated gram.  Every gram picks the same anchor in
all of its occurrences: the least hash among its k-word windows, the leftmost
one of ties.  So the occurrences of equal grams meet under the anchor's hash,
and each anchor occurrence stands for a context, the text that holds exactly
the grams which picked it.  Texts are not compared across anchors, and nothing
is lost: grams of different anchors differ.

Under one anchor, equal contexts (one 64-bit hash, under one anchor hash) are
collapsed to the first of them.  Where contexts differ, the first of each kind
is fetched from the documents, runs of words that only occur together become
one symbol with a length, and a suffix array (:mod:`docwarden.llm.lyndon`) of
the contexts tells for each suffix how far it repeats an earlier one and how
far anything repeats it.

Scale: one shuffle carries about 40 bytes per anchor (one per dozen words), one
more the contexts that differ, and the texts move once, to meet the requests
for their contexts.  Contexts of one anchor hash meet in one task, so two kinds
of anchors are taken apart before the shuffle.  Equal contexts that one task has
are collapsed to the first of them, and the others become marks at once.  And
where an anchor has very many contexts (a licence line with many surroundings),
each of its grams becomes an anchor and context of its own: equal grams still
meet, and nothing needs a suffix array.  Which anchors those are is estimated on
every sixteenth document; both ways give the same result, so the estimate only
decides about speed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.base import cut, doc_columns, lean, replaced, unwrapped, version_of, whole_rows, with_text
from docwarden.llm.lyndon import common_prefixes, suffix_array
from docwarden.llm.textkernels import EXACT, EXACT_CODES, Words, geometric_pair, gram_hashes, mix, runs, sliding_min, string_parts

MIN_WORDS = 50
ANCHOR_WORDS = 25
#: an anchor of more contexts than this, and of more than this share of all, is taken apart
CROWD = 4096
CROWD_SHARE = 1e-4
_SAMPLED = 16
_HELD = 1 << 18
_FOUND = ["anchor", "context", "doc_id", "version", "span", "weight"]
_FOUND_TYPES = "anchor long, context long, doc_id long, version long, span long, weight long"


def _collapse(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of (anchor, context, doc_id, version, span) with weights: the first of equal contexts has their number.

    The others have weight 0 and an anchor of their own, so that they are spread.
    """
    anchor, context, doc, version, span = (np.concatenate(x) for x in zip(*parts))
    weight = np.ones(len(anchor), dtype=np.int64)
    key = mix(anchor.view(np.uint64)) ^ context.view(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])))
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [len(key)])))
    if len(start) < len(key):
        many = np.repeat(size > 1, size)
        mine, group = order[many], np.repeat(np.arange(len(start)), size)[many]
        mine = mine[np.lexsort((span[mine], version[mine], doc[mine], group))]
        group = np.repeat(np.flatnonzero(size > 1), size[size > 1])
        lead = np.concatenate(([True], group[1:] != group[:-1]))
        weight[mine[lead]] = size[size > 1]
        later = mine[~lead]
        weight[later] = 0
        anchor = anchor.copy()
        anchor[later] = mix(doc[later].view(np.uint64) * np.uint64(3) ^ span[later].view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, context, doc, version, span, weight)], names=_FOUND)


def _anchors(min_words: int, anchor_words: int, crowded: list[int]):
    window = min_words - anchor_words + 1
    apart = np.array(sorted(crowded), dtype=np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for part in find(batches):
            held.append(part)
            rows += len(part[0])
            if rows >= _HELD:
                yield _collapse(held)
                held, rows = [], 0
        if held:
            yield _collapse(held)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids, versions = batch["doc_id"].to_numpy(), batch["version"].to_numpy()
            for first, _, words in runs(batch["text"]):
                n = len(words.hash)
                if n < min_words:
                    continue
                grams = gram_hashes(words.hash, anchor_words)
                least = sliding_min(grams, window)
                # position of the leftmost least hash of each gram: the next place where the hash equals the least
                doc = words.doc_of()
                starts = np.flatnonzero(doc[: n - min_words + 1] == doc[min_words - 1 :])
                if not len(starts):
                    continue
                at = _leftmost(grams, least, starts, window)
                new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])))
                lead = np.flatnonzero(new)
                count = np.diff(np.concatenate((lead, [len(starts)])))
                lo, anchor = starts[lead], grams[at[lead]].view(np.int64)
                if len(apart):
                    crowd = np.isin(anchor, apart)
                    if crowd.any():
                        times = np.where(crowd, count, 1)
                        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                        lo, count, single = np.repeat(lo, times) + step, np.repeat(np.where(crowd, 1, count), times), np.repeat(crowd, times)
                        anchor = np.repeat(anchor, times)
                        anchor[single] = mix(_range_hash(words.hash, lo[single], np.full(int(single.sum()), min_words)) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
                context = _range_hash(words.hash, lo, count + min_words - 1)
                d = doc[lo]
                yield anchor, context.view(np.int64), ids[first + d], versions[first + d], (lo - words.doc_start[d]).astype(np.int64) << 12 | count

    return emit


def _leftmost(grams: np.ndarray, least: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """First position at or after each start whose hash is the least of the start's window."""
    at = starts.copy()
    todo = np.flatnonzero(grams[at] != least[starts])
    while len(todo):
        # all starts from here to the place of the least share it: step on from start to start
        at[todo] += 1
        todo = todo[grams[at[todo]] != least[starts[todo]]]
    return at


def _range_hash(h: np.ndarray, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of h[lo:lo + length], from prefix sums of a polynomial."""
    up, down = geometric_pair(len(h))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return mix((sums[lo + length] - sums[lo]) * down[lo] + length.astype(np.uint64))


def _contexts(min_words: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the requested contexts; each row has a document and its requests."""
        for batch in batches:
            requests = batch["requests"]
            per_doc = np.diff(requests.offsets.to_numpy())
            fields = requests.flatten()
            owner = np.repeat(np.arange(len(batch)), per_doc)
            span = fields.field("span").to_numpy()
            lo, count = span >> 12, span & 4095
            for first, stop, words in runs(batch["text"]):
                mine = np.flatnonzero((owner >= first) & (owner < stop))
                if not len(mine):
                    continue
                begin = words.doc_start[owner[mine] - first] + lo[mine]
                byte_lo, byte_hi = words.start[begin], words.end[begin + count[mine] + min_words - 2]
                texts = pa.array([words.data[a:b].tobytes() for a, b in zip(byte_lo, byte_hi)], pa.binary())
                chosen = fields.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays(
                    [chosen.field("anchor"), *(batch[c].take(pa.array(owner[mine])) for c in ("doc_id", "version")), chosen.field("span"), chosen.field("copies"), texts.cast(pa.string())],
                    names=["anchor", "doc_id", "version", "span", "copies", "text"],
                )

    return fetch


def _runs_of_words(group: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols for words, with which runs start: words of a group that only occur together form one run."""
    _, symbol = np.unique(mix(word + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    n = len(symbol)
    inner = context[1:] == context[:-1]
    follows = np.full(n, -1)
    follows[:-1][inner] = symbol[1:][inner]
    leads = np.full(n, -1)
    leads[1:][inner] = symbol[:-1][inner]
    order = np.argsort(symbol, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(symbol[order]) > 0)))
    only = lambda x: np.where(np.minimum.reduceat(x[order], edges) == np.maximum.reduceat(x[order], edges), x[order][edges], -1)
    next_of, last_of = only(follows), only(leads)
    joined = np.zeros(n, dtype=bool)
    joined[1:] = inner & (next_of[symbol[:-1]] == symbol[1:]) & (last_of[symbol[1:]] == symbol[:-1])
    return symbol, ~joined


def repeated_extents(symbols: list[int], weights: list[int], rest: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix, how many words repeat an earlier suffix, and how many repeat any other one.

    ``symbols`` has separators that occur once between contexts; ``rest`` is the
    number of words before each position.
    """
    n = len(symbols)
    order = suffix_array(symbols)
    lcp = common_prefixes(symbols, order)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    any_other, earlier = [0] * n, [0] * n
    for i, r in enumerate(rank):
        h = max(lcp[r], lcp[r + 1] if r + 1 < n else 0)
        any_other[i] = rest[i + h] - rest[i]
    # suffixes leave the order from the last position on, so the neighbours left are earlier ones
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    shared = lcp + [0]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        h = max(shared[r], shared[right[r]])
        earlier[i] = rest[i + h] - rest[i]
        shared[right[r]] = min(shared[r], shared[right[r]])
        if left[r] >= 0:
            right[left[r]] = right[r]
        if right[r] < n:
            left[right[r]] = left[r]
    return earlier, any_other


def _marks_of_group(contexts: list[tuple[int, int, int, int]], symbol: np.ndarray, starts: np.ndarray, min_words: int) -> Iterator[tuple[int, int, int, bool]]:
    """Marks (context, start word, end word, cut) of one anchor's contexts, which come in order of (doc_id, version, span).

    contexts: (first position, length, index of the document's word, copies).
    """
    symbols, weights, rest, where = [], [], [0], []
    for c, (at, length, _, _) in enumerate(contexts):
        heads = np.flatnonzero(starts[at : at + length])
        ends = np.concatenate((heads[1:], [length]))
        symbols += symbol[at + heads].tolist()
        weights += (ends - heads).tolist()
        where += [(c, int(x)) for x in heads]
        symbols.append(-1 - c)
        weights.append(0)
        where.append((c, length))
    for w in weights:
        rest.append(rest[-1] + w)
    earlier, any_other = repeated_extents(symbols, weights, rest)
    for i, (c, x) in enumerate(where):
        _, length, _, copies = contexts[c]
        a, m = earlier[i], any_other[i]
        if copies > 1:
            m = length - x
        if m < min_words or not weights[i]:
            continue
        if a >= min_words:
            yield c, x, x + a, True
        lo = max(0, a - min_words + 1)
        hi = min(weights[i] - 1, m - min_words)
        if lo <= hi:
            yield c, x + lo, x + hi + min_words, False


def _sorter(min_words: int):
    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by (anchor, doc_id, version, span)."""
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            data, bounds = string_parts(table["text"])
            words = Words(data, bounds, EXACT, EXACT_CODES)
            anchor, doc_id, version = (table[c].to_numpy() for c in ("anchor", "doc_id", "version"))
            lo, copies = table["span"].to_numpy() >> 12, table["copies"].to_numpy()
            context = words.doc_of()
            symbol, starts = _runs_of_words(anchor.view(np.uint64)[context], context, words.hash)
            at, length = words.doc_start[:-1], np.diff(words.doc_start)
            edges = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]))
            out: list[tuple[int, int, int, bool]] = []
            for g, h in zip(edges[:-1].tolist(), edges[1:].tolist()):
                group = [(int(at[r]), int(length[r]), int(lo[r]), int(copies[r])) for r in range(g, h)]
                out += [(g + c, a, b, gone) for c, a, b, gone in _marks_of_group(group, symbol, starts, min_words)]
            if out:
                row, a, b, gone = (np.array(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(doc_id[row]), pa.array(version[row]), pa.array(lo[row] + a), pa.array(lo[row] + b), pa.array(gone.astype(bool))], names=["doc_id", "version", "start_word", "end_word", "gone"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch["anchor"].to_numpy()
            split = int(np.searchsorted(anchor, anchor[-1]))
            if split or (held and held[-1]["anchor"][-1].as_py() != anchor[0]):
                table = pa.Table.from_batches([*held, batch.slice(0, split)])
                if table.num_rows:
                    yield from flush(table)
                held = [batch.slice(split)]
            else:
                held.append(batch)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return sort_groups


def crowded_anchors(docs: DataFrame, min_words: int, anchor_words: int) -> list[int]:
    """Anchors that seem to have so many contexts that one task shouldn't hold them; at most 1 / CROWD_SHARE of them."""
    sampled = docs.filter(F.pmod(F.xxhash64("doc_id", "version"), F.lit(_SAMPLED)) == 0)
    counts = sampled.mapInArrow(lean(_anchors(min_words, anchor_words, [])), _FOUND_TYPES).filter("weight > 0").groupBy("anchor").agg(F.count("*").alias("n"))
    often = cut(counts.filter(F.col("n") > CROWD / _SAMPLED))
    if often.isEmpty():
        return []
    total = counts.agg(F.sum("n")).first()[0]
    return [r["anchor"] for r in often.filter(F.col("n") > total * CROWD_SHARE).collect()]


def _marks(docs: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """Marks (doc_id, version, start_word, end_word, gone): gone where grams occurred before, else where a repeated gram occurs first."""
    if not anchor_words < min_words <= 2048:
        raise ValueError("anchor_words < min_words <= 2048 is needed")
    crowded = crowded_anchors(docs, min_words, anchor_words)
    found = docs.mapInArrow(lean(_anchors(min_words, anchor_words, crowded)), _FOUND_TYPES).repartition("anchor")
    kind, hashed = Window.partitionBy("anchor", "context"), Window.partitionBy("anchor")
    seen = (
        found.withColumn("nth", F.row_number().over(kind.orderBy("doc_id", "version", "span")))
        .withColumn("copies", F.sum("weight").over(kind))
        .withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(hashed))
        .filter("copies > 1 or kinds > 1 or weight = 0")
    )
    seen = cut(seen)
    end = (F.shiftright("span", 12) + F.col("span").bitwiseAND(4095) + (min_words - 1)).alias("end_word")
    gone = ((F.col("nth") > 1) | (F.col("weight") == 0)).alias("gone")
    whole = seen.filter("nth > 1 or kinds = 1 or weight = 0").select("doc_id", "version", F.shiftright("span", 12).alias("start_word"), end, gone)
    wanted = seen.filter("nth = 1 and kinds > 1 and weight > 0").groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "span", "copies")).alias("requests"))
    fetched = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "version"]).mapInArrow(lean(_contexts(min_words)), "anchor long, doc_id long, version long, span long, copies long, text string")
    sorted_ = fetched.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "version", "span").mapInArrow(lean(_sorter(min_words)), "doc_id long, version long, start_word long, end_word long, gone boolean")
    return whole.unionByName(sorted_)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, version, marks in zip(batch["doc_id"].to_pylist(), batch["version"].to_pylist(), batch["marks"].to_pylist()):
            rows += [(doc, version, *x) for x in resolve([(m["start_word"], m["end_word"], m["gone"]) for m in marks])]
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "version", "start_word", "end_word", "is_cut"])


def resolve(marks: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    """Disjoint intervals (start, end, cut) of one document: a word that a kept mark covers is never cut."""
    edges: list[tuple[int, int, int]] = []
    for a, b, gone in marks:
        edges += [(a, 1, gone), (b, -1, gone)]
    edges.sort()
    out: list[tuple[int, int, bool]] = []
    depth, last = [0, 0], 0
    for at, change, gone in edges:
        state = None if not depth[0] and not depth[1] else not depth[0]
        if state is not None and at > last:
            if out and out[-1][1] == last and out[-1][2] == state:
                out[-1] = (out[-1][0], at, state)
            else:
                out.append((last, at, state))
        depth[gone] += change
        last = at
    return out


def _intervals(known: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """Rows (doc_id, version, start_word, end_word, is_cut) of documents (doc_id, version, text)."""
    marks = _marks(known, min_words, anchor_words).groupBy("doc_id", "version").agg(F.collect_set(F.struct("start_word", "end_word", "gone")).alias("marks"))
    return marks.mapInArrow(lean(_differences), "doc_id long, version long, start_word long, end_word long, is_cut boolean")


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Rows (doc_id, start_word, end_word, is_cut) for the words of grams that occur more than once.

    A gram is ``min_words`` consecutive words of one document.  Of the
    occurrences of a repeated gram, the one of least (doc_id, start) is its
    first.  A word is kept (``is_cut`` false) if a first occurrence covers it,
    and cut if only later occurrences do; so each repeated gram stays whole once.
    Intervals count words from 0, exclude their end, are disjoint and as long as
    can be.  Defined cases: documents of fewer words, empty or null texts and
    null ids have no rows; repeats inside one document count; rows that repeat
    both id and text are one document; unlike texts of one id are documents of
    their own (in the order of a hash of the text), and their intervals all have
    that id; an empty table gives no rows; columns besides doc_id and text are
    not looked at.
    """
    return _intervals(_distinct(docs)[0], min_words, anchor_words).drop("version")


def _distinct(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct documents (doc_id, version, text), and whether ids repeat; without repeats all versions are 0."""
    known = doc_columns(docs).filter("doc_id is not null and text is not null")
    # only ids that repeat are made distinct, so that texts don't move for a table without them
    twice = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if twice.isEmpty():
        return known.select("doc_id", F.lit(0).cast("long").alias("version"), "text"), False
    several = known.join(twice, "doc_id", "left_semi").distinct()
    every = known.join(twice, "doc_id", "left_anti").unionByName(several)
    return every.select("doc_id", version_of(F.col("text")).alias("version"), "text"), True


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives the rows back with what is left of their text; ``cuts`` has the cut intervals or null."""
    for batch in batches:
        names, columns = unwrapped(batch)
        at = names.index("text")
        cuts = batch["cuts"].to_pylist()
        marked = [i for i, x in enumerate(cuts) if x]
        if marked:
            texts: dict[int, str] = {}
            for first, stop, words in runs(columns[at].take(pa.array(marked))):
                for d in range(stop - first):
                    i = marked[first + d]
                    raw = words.data[words.doc_byte[d] : words.doc_byte[d + 1]].tobytes()
                    base, w0, w1 = words.doc_byte[d], words.doc_start[d], words.doc_start[d + 1]
                    out, last = [], 0
                    for x in sorted((x["lo"], x["hi"]) for x in cuts[i]):
                        lo, hi = w0 + x[0], w0 + x[1]
                        out.append(raw[last : words.start[lo] - base])
                        last = (words.start[hi] - base) if hi < w1 else len(raw)
                    texts[i] = b"".join([*out, raw[last:]]).decode("utf-8")
            columns[at] = replaced(columns[at], texts)
        yield pa.RecordBatch.from_arrays(columns, names=names)


def cut_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """The documents without the words that :func:`repeated_passages` cuts; all rows and columns stay.

    White space after a cut passage goes with it.  ``n_chars`` follows the text.
    Defined cases: rows with a null id or text and texts of fewer words stay as
    they are, null texts null; rows that repeat both id and text are one document
    and are all cut alike; of unlike texts of one id each is cut by its own
    intervals; a text that is all repeats becomes empty; an empty table stays
    empty; other columns may have any names.
    """
    known, repeat = _distinct(docs)
    gone = _intervals(known, min_words, anchor_words).filter("is_cut")
    cuts = gone.groupBy("doc_id", "version").agg(F.collect_list(F.struct(F.col("start_word").alias("lo"), F.col("end_word").alias("hi"))).alias("cuts"))
    version = version_of(docs["text"].cast("string")) if repeat else F.lit(0).cast("long")
    rows = whole_rows(docs, docs["doc_id"].cast("long").alias("doc_id"), version.alias("version"))
    joined = rows.join(cuts, ["doc_id", "version"], "left").select("row", "cuts")
    return with_text(joined.mapInArrow(lean(_cutter), docs.schema), F.col("text"))

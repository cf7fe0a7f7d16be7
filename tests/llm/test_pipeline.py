"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from docwarden.llm import packing, repeats, secrets, simhash, toxicity
from test_operators import brute_passages, plain_verdict, words


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "secret_scan", "best_fit_packing"]


def test_each_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == columns
            assert {f.name: f.dataType for f in after.schema} == {f.name: f.dataType for f in docs.schema}
        before_ids, after_ids = (Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in (docs, after))
        if name == "toxicity":
            gone = {r["doc_id"] for r in toxicity.toxic_documents(docs, labels).collect()}
            assert set(before_ids) - set(after_ids) == gone
        elif name == "simhash_near_dedup":
            assert set(before_ids) - set(after_ids) == {r["doc_id"] for r in simhash.near_duplicates(docs).collect()}
        elif name == "suffix_array_dedup":
            assert before_ids == after_ids
            assert repeats.repeated_passages(after).filter("is_cut").count() <= repeats.repeated_passages(docs).filter("is_cut").count()
        elif name == "secret_scan":
            assert before_ids == after_ids
            tokens = {(r["doc_id"], r["token"]) for r in secrets.find_secrets(docs).collect()}
            text = {r["doc_id"]: r["text"] for r in after.select("doc_id", "text").collect()}
            assert not any(t in text[d] for d, t in tokens)
        seen.append(name)
        docs = after
    assert docs.count()


def _without_toxic(rows):
    return [r for r in rows if not plain_verdict(r[1], {})]


def _without_near(rows):
    """All pairs of signatures; of each connected group the row of least id stays."""
    import pyarrow as pa

    sigs = [[int(x) for x in s] for s in simhash.signatures_of(pa.array([t for _, t in rows]))]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sum((a ^ b).bit_count() for a, b in zip(sigs[i], sigs[j])) <= simhash.RADIUS:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    assert order == list(range(len(rows)))
    return [r for i, r in enumerate(rows) if find(i) == i]


def _without_repeats(rows):
    _, gone = brute_passages(rows, repeats.MIN_WORDS)
    out = []
    for doc, text in rows:
        kept = [m.group() for n, m in enumerate(re.finditer(r"\S+\s*", text)) if (doc, n) not in gone]
        out.append((doc, "".join(kept)))
    return out


def _packed(spark, rows, capacity):
    """The rule by trying every open bin, in the order of the operator's hash."""
    lengths = spark.createDataFrame([(d, len(t.split())) for d, t in rows if t.split()], "doc_id long, n_words long")
    turns = lengths.withColumn("turn", F.xxhash64("doc_id", "n_words", F.lit(1).cast("long"))).orderBy("turn").collect()
    bins, out = [], []
    for r in turns:
        for start in range(0, r["n_words"], capacity):
            size = min(capacity, r["n_words"] - start)
            gaps = np.bincount([b for b in bins if b], minlength=capacity + 1)

            def cost(gap, gaps=gaps, size=size):
                after = gaps.copy()
                if gap < capacity + 1:
                    after[gap] -= 1
                rest = min(gap, capacity) - size
                if rest:
                    after[rest] += 1
                return int((after**2).sum())

            fits = sorted({b for b in bins if b >= size})
            if size == capacity:
                fits = []
            # of ties an exact fit, then the smallest gap, then a new bin
            best = min([*fits, capacity + 1], key=lambda g: (cost(g), g))
            if best > capacity:
                bins.append(capacity)
                number = len(bins) - 1
            else:
                number = next(i for i in waiting if bins[i] == best) if (waiting := _by_age(out, bins)) else bins.index(best)
            out.append((number, capacity - bins[number], r["doc_id"], start, size))
            bins[number] -= size
    return out


def _by_age(out, bins):
    """Open bins, the one longest at its present gap first."""
    last = {}
    for turn, piece in enumerate(out):
        last[piece[0]] = turn
    return sorted((i for i, b in enumerate(bins) if b), key=lambda i: last[i])


def test_each_stage_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    passage = words(60, 1)
    rows = [(i, f"{words(40, i + 10)} {passage if i % 5 == 0 else ''} {words(30, i + 500)}.") for i in range(60)]
    rows += [(100 + i, t + " tail") for i, (_, t) in enumerate(rows[:20])]
    rows += [(200 + i, f"{words(9, 900 + i)}. {line} {words(9, 950 + i)}") for i, line in enumerate(["you idiot.", "the stupid door is broken.", "I will kill you.", "he said you are an idiot.", "scum. trash. what a loser."])]
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(6)]
    rows += [(300 + i, f"{words(50, 700 + i)} key={k} {words(5, 800 + i)}") for i, k in enumerate(keys)]
    sf = tmp_path / "sf"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    masked = lambda rs: [(d, re.sub("|".join(keys), secrets.MASK, t)) for d, t in rs]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, [_without_toxic, _without_near, _without_repeats, masked]):
        stage(spark, docs, str(sf)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        expected = plain(rows)
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(expected), name
        assert len(expected) < len(rows) or expected != rows, name
        rows = sorted(expected)
    found = [(r["bin_id"], r["bin_offset"], r["doc_id"], r["start_word"], r["n_words"]) for r in packing.pack_documents(docs, capacity=128).collect()]
    assert sorted(found) == sorted(_packed(spark, rows, 128))
    assert corpus_pipeline.pack(spark, docs, str(sf)).agg(F.sum("n_words")).first()[0] == sum(len(t.split()) for _, t in rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == ["bin_id", "bin_offset", "doc_id", "start_word", "n_words"]


@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_odd_tables(spark, tmp_path, empty):
    rows = [] if empty else [(1, None, None, None, None), (None, "text without an id", "en", "s", 18), (2, "", "en", "s", 0), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
    assert [r["doc_id"] for r in docs.collect()] == ([] if empty else [3])

"""Corpus operators on small tables: brute force, and the cases that docstrings define."""

from __future__ import annotations

import hashlib
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR, same_rows

from docwarden.llm import bpe, importance, inner_products, matroska, packing, queries, repeats, secrets, simhash, toxicity, warc

#: names that operators use themselves
CLASHING = ["bucket", "rep", "n", "token_ids", "cuts", "__id", "__rank", "__marked", "__lost_id", "row", "version", "apart", "free", "place", "node", "a.b", "kept", "start_word", "media"]
ROW = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
STAGES = ["drop_toxic", "drop_near_duplicates", "cut_repeats", "redact_secrets"]


def table(spark, rows):
    """Documents of (doc_id, text) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *(f"{c} of {i}" for c in CLASHING)) for i, t in rows], ROW)


def staged(name, docs, labels):
    """Rows that a row-keeping stage gives."""
    return {
        "drop_toxic": lambda: toxicity.drop_toxic(docs, labels),
        "drop_near_duplicates": lambda: simhash.drop_near_duplicates(docs),
        "cut_repeats": lambda: repeats.cut_repeats(docs),
        "redact_secrets": lambda: secrets.redact_secrets(docs),
    }[name]()


def words(n: int, seed: int, size: int = 5) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=size)) for _ in range(n))


LONG = words(60_000, 1)
ODD = [(1, None), (None, "no id here"), (2, ""), (3, "  \n\t "), (4, "same text again"), (4, "same text again"), (5, "ünï ‮ \U0001f600 \u0000 end"), (6, LONG), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# stages that keep rows


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_every_column(spark, odd, empty, no_labels, name):
    out = staged(name, odd, no_labels)
    assert out.schema.names == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = out.collect()
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert staged(name, empty, no_labels).columns == odd.columns and staged(name, empty, no_labels).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_judge_unlike_texts_of_one_id_apart(spark, no_labels, name):
    p, q, key = words(60, 1), words(60, 2), "".join(random.Random(3).choices("0123456789abcdef", k=40))
    given = [(1, p), (2, "z " + p), (2, "a " + q), (2, f"key {key} for {q[:50]}"), (2, "you are an idiot. " + words(70, 9)), (2, None), (2, "a " + q), (None, q), (None, None)] + [(2, words(80, 20 + i)) for i in range(5)]
    found = Counter((r["doc_id"], r["text"]) for r in staged(name, table(spark, given), no_labels).collect())
    expected = Counter(given)
    if name == "drop_toxic":
        expected -= Counter([given[4]])
    elif name == "drop_near_duplicates":
        expected -= Counter([(2, "z " + p), (2, "a " + q)])
    elif name == "cut_repeats":
        expected += Counter([(2, "z ")])
        expected -= Counter([(2, "z " + p)])
    else:
        expected += Counter([(2, given[3][1].replace(key, secrets.MASK))])
        expected -= Counter([given[3]])
    assert found == expected


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert same_rows(queries.QUERIES[name](spark, SF_DIR), duck, queries.ORACLE_SQL[name])


# packing


def test_packing(spark, odd, empty):
    rows = packing.pack_documents(odd).collect()
    counts = Counter()
    bins = defaultdict(list)
    for r in rows:
        counts[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]].append((r["bin_offset"], r["n_words"]))
    assert counts == {4: 6, 5: 5, 6: 60_000}
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack_documents(empty).count() == 0


def test_packing_covers_every_word_of_all_shards(spark):
    lengths = spark.createDataFrame([(i, 1 + i * 37 % 500) for i in range(500)], "doc_id long, n_words long")
    rows = packing.pack_lengths(lengths, capacity=128, shard_words=9000).collect()
    covered = defaultdict(set)
    for r in rows:
        span = set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert not covered[r["doc_id"]] & span
        covered[r["doc_id"]] |= span
    assert {k: len(v) for k, v in covered.items()} == {i: 1 + i * 37 % 500 for i in range(500)}
    assert len({r["bin_id"] >> 40 for r in rows}) > 1
    used = sum(r["n_words"] for r in rows) / (128 * len({r["bin_id"] for r in rows}))
    assert used > 0.95


def test_packing_bounds_shards_by_rows_and_spreads_a_hot_id(spark):
    lengths = spark.range(40_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "1L as n_words")
    rows = packing.pack_lengths(lengths, shard_rows=5000).collect()
    shards = Counter(r["bin_id"] >> 40 for r in rows)
    assert len(rows) == 40_000 and len(shards) == 8 and max(shards.values()) < 6000
    assert Counter(r["doc_id"] for r in rows)[7] == 13_335


# media


def test_media_of_odd_documents(spark, odd, empty):
    rows = matroska.document_packets(odd).collect()
    assert all(r["is_sound"] for r in rows)
    texts = defaultdict(int)
    for r in rows:
        texts[r["doc_id"]] += 1
    assert None in texts and 6 in texts and 1 not in texts
    assert matroska.document_packets(empty).count() == 0


def test_packets_give_back_the_bytes(spark):
    docs = table(spark, [(1, "first line. more.\nsecond line"), (2, "x")])
    media = {r["doc_id"]: bytes(r["media"]) for r in matroska.films(docs).collect()}
    lines = defaultdict(list)
    for r in matroska.document_packets(docs).orderBy("doc_id", "packet").collect():
        if r["track"] == 1:
            lines[r["doc_id"]].append(media[r["doc_id"]][r["byte_offset"] : r["byte_offset"] + r["byte_length"]].decode())
    assert lines == {1: ["first line. more.", "second line"], 2: ["x"]}


def test_media_that_are_none(spark):
    files = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"junk" * 9)), (None, bytearray(matroska.text_media("a\nb")))], "doc_id long, media binary")
    assert {r["doc_id"] for r in matroska.packets(files).collect()} == {None}


def test_lines_of_very_many_sentences(spark):
    text = ". ".join(f"s{i}" for i in range(1000))
    rows = matroska.document_packets(table(spark, [(1, text)])).collect()
    assert len(rows) == 1001 and all(r["is_sound"] for r in rows)
    assert max(r["lace_index"] for r in rows) == 255 and len({r["byte_offset"] for r in rows if r["track"] == 2}) == 1000


# byte-level BPE


def test_bpe_round_trip(spark, odd, empty):
    encoded = bpe.encode(odd, chunk_chars=1000)
    rows = bpe.decode(encoded).collect()
    found = Counter((r["doc_id"], None if r["bytes"] is None else bytes(r["bytes"]).decode()) for r in rows)
    assert found == Counter(ODD)
    assert bpe.encode(empty).count() == 0


def test_bpe_check(spark, odd):
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    rows = bpe.encode_and_check(odd).collect()
    assert Counter((r["doc_id"], r["text_md5"]) for r in rows) == Counter((d, md5(t)) for d, t in ODD)
    assert all((r["n_tokens"] is None) == (r["token_ids"] is None) and (r["n_tokens"] or 0) == len(r["token_ids"] or []) for r in rows)


def test_bpe_equals_the_public_encoder(spark, odd):
    import tiktoken

    encoder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    text_of = dict(ODD)
    for r in bpe.encode(odd).collect():
        if r["doc_id"] is not None:
            text = text_of[r["doc_id"]]
            assert r["token_ids"] == (None if text is None else encoder.encode_ordinary(text))


# WARC


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", 1), (2, None, "<p>x</p>", 1), (None, "http://b/", "y", 1), (3, "http://c/\r\nX: y", "", 1), (4, "http://d/", None, 1), (5, "http://e/", "<p>" + LONG, 1), (5, "http://e/", "other", 1)], "page_id long, url string, html string, offset int")
    rows = {(r["page_id"], r["url"], r["html_md5"]) for r in warc.distinct_pages(pages).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert rows == {(1, "http://a/", md5("<p>x</p>")), (3, "http://c/X: y", md5("")), (5, "http://e/", md5("<p>" + LONG)), (5, "http://e/", md5("other"))}
    assert warc.distinct_pages(pages.limit(0)).count() == 0


def test_warc_ranges_that_hold_no_record(spark, tmp_path):
    import gzip

    record = warc.record_bytes(7, " http://a/\u2028b ", "<p>")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"no record") + record)
    index = warc.index_warc(spark, str(tmp_path)).collect()
    assert [(r["url"], r["record_id"]) for r in index] == [("http://a/\u2028b", "<urn:page:7>")]
    file, offset, length = index[0]["file"], index[0]["offset"], index[0]["length"]
    asked = spark.createDataFrame([(file, offset, length), (file, offset, length), (file, 0, offset), (file, offset, length - 4), (None, 0, 1), (file, None, 1)], "file string, offset long, length long")
    rows = warc.read_records(asked).collect()
    assert [bytes(r["body"]) for r in rows] == [b"<p>"] * 2 and all(r["sound"] for r in rows)
    assert warc.read_records(asked.limit(0)).count() == 0


# top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 7)) * rng.exponential(size=(300, 1)), 2)
    x[10:20] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(7, [9.0] * 7, 1), (None, x[0].tolist(), 1), (900, None, 1), (901, [], 1), (902, [1.0], 1), (903, [float("nan")] * 7, 1), (904, [None] * 7, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    x[7] = min(x[7].tolist(), [9.0] * 7)
    score = np.round(x @ x.T, 6)
    expected = {}
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-score[i, j], j))[:10]
        expected[i] = [(j, score[i, j]) for j in order]
    found = defaultdict(list)
    for r in inner_products.top_inner_products(vectors, block_rows=64).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(expected)
    for i in expected:
        assert [s for _, s in found[i]] == pytest.approx([s for _, s in expected[i]], abs=2e-6)
    assert sum(a == b for i in expected for (a, _), (b, _) in zip(found[i], expected[i])) >= 2990
    assert inner_products.top_inner_products(vectors.limit(0)).count() == 0
    some = defaultdict(list)
    for r in inner_products.top_inner_products(vectors, every=20, block_rows=16).orderBy("query_id", "rank").collect():
        some[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(some) == set(range(0, 300, 20)) and all(some[i] == found[i] for i in some)


def test_blocks_are_skipped_and_nothing_is_lost(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 12)) * 0.1 + rng.normal(size=(20, 12))[rng.integers(0, 20, 4000)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    folder = f"file://{tmp_path}"
    one = vectors.selectExpr("vec_id as id", "embedding as v").mapInArrow(inner_products._rotater(np.eye(12)), "id long, length double, y binary").orderBy("length", ascending=False)
    one.mapInArrow(inner_products._blocker(f"{folder}/blocks", 64), inner_products._PLACES).write.parquet(f"{folder}/places")
    best, seen = inner_products.search(inner_products.Blocks(folder), np.arange(5), x[:5], 3, 4)
    score = x[:5] @ x.T
    score[np.arange(5), np.arange(5)] = -np.inf
    assert np.allclose(best.score, np.sort(score, axis=1)[:, :-4:-1], atol=2e-6)
    assert seen["pairs"] == 20_000 and seen["partial"] < 0.5 * seen["pairs"] and seen["whole"] < seen["partial"]


# secrets


def test_secrets(spark, odd, empty):
    rng = random.Random(4)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(20)] + ["".join(rng.choices(string.ascii_letters + string.digits, k=32)) for _ in range(20)]
    prose = [(100 + i, words(300, i, 4) + " thisisaverylongordinaryword internationalization") for i in range(60)]
    rows = prose + [(1000 + i, f"key: {k} and {k}.") for i, k in enumerate(keys)] + [(2000, "0" * 40 + " " + "abcd" * 12)]
    docs = table(spark, rows)
    found = secrets.find_secrets(docs).collect()
    caught = {r["token"] for r in found}
    assert len(caught & set(keys)) >= 38
    assert not {r["doc_id"] for r in found} & ({d for d, _ in prose} | {2000})
    text_of = dict(rows)
    for r in found:
        assert text_of[r["doc_id"]].encode()[r["byte_offset"] :].startswith(r["token"].encode())
    clean = {r["doc_id"]: r for r in secrets.redact_secrets(docs).collect()}
    assert set(clean) == set(text_of) and clean[100]["text"] == text_of[100]
    assert not any(k in clean[1000 + i]["text"] for i, k in enumerate(keys) if k in caught)
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in secrets.redact_secrets(odd).collect()))) == sorted(map(repr, ODD))
    assert secrets.find_secrets(empty).count() == 0 and secrets.redact_secrets(empty).count() == 0


def test_secrets_joined_to_other_text(spark):
    rng = random.Random(11)
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    some = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    uuid = lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))
    kinds = {
        "key": lambda: ("key-", some(hexes, 32), ""),
        "sk_test": lambda: ("sk_test_", some(hexes, 32), ""),
        "path": lambda: ("api/v1/", some(hexes, 40), "/edit"),
        "long path": lambda: ("v1/projects/default/secrets/", some(mixed + "+/", 40), ""),
        "numbers": lambda: (f"xoxb-{some(string.digits, 12)}-{some(string.digits, 12)}-", some(mixed, 32), ""),
        "letters": lambda: ("SK", some(hexes, 32), ""),
        "upper": lambda: ("", some(upper, 40), ""),
        "upper after letters": lambda: ("AKIA", some(upper, 16), ""),
        "uuid": lambda: ("users/", uuid(), ""),
    }
    made = [(kind, *make()) for kind, make in kinds.items() for _ in range(20)]
    two = [(some(hexes, 32), some(hexes, 32)) for _ in range(10)]
    prose = [(i, words(300, i, 4) + " state-of-the-art/internationalization_of_ordinary-words 2024-01-02-2024-03-04") for i in range(60)]
    rows = prose + [(1000 + i, f"see {before}{key}{after} there") for i, (_, before, key, after) in enumerate(made)] + [(2000 + i, f"{a}/{b}") for i, (a, b) in enumerate(two)]
    docs = table(spark, rows)
    found = secrets.find_secrets(docs).collect()
    tokens = {}
    for r in found:
        tokens.setdefault(r["doc_id"], []).append(r["token"])
        assert dict(rows)[r["doc_id"]].encode()[r["byte_offset"] :].startswith(r["token"].encode())
    missed = [kind for i, (kind, _, key, _) in enumerate(made) if not any(key in t for t in tokens.get(1000 + i, []))]
    assert all(missed.count(kind) <= 2 for kind in kinds), missed
    assert sum(all(any(k in t for t in tokens.get(2000 + i, [])) for k in pair) for i, pair in enumerate(two)) >= 9
    assert min(tokens) >= 1000
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert sum(key in clean[1000 + i] for i, (_, _, key, _) in enumerate(made)) <= len(missed)


@pytest.mark.parametrize("folders", [5, 12, 60, 400])
def test_secrets_behind_paths_of_any_length(spark, folders):
    # the keys hold the separators of their own alphabets, so only a hypothesis that begins behind the path is the key
    rng = random.Random(folders)
    names = "projects default versions users groups public shared archive records settings".split()
    made = []
    for i in range(20):
        sign = "/" if i % 2 else "-"
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=59))
        key = "".join(c + sign if j % 10 == 9 else c for j, c in enumerate(key))
        made.append((sign.join(rng.choices(names, k=folders)) + sign, key))
    prose = [(i, words(300, i, 4)) for i in range(60)]
    docs = table(spark, prose + [(1000 + i, f"see {path}{key} there") for i, (path, key) in enumerate(made)])
    tokens = defaultdict(list)
    for r in secrets.find_secrets(docs).collect():
        tokens[r["doc_id"]].append(r["token"])
    # the first ten characters and their separator may be cut off, or some folders stay
    assert sum(any(key[11:] in t and len(t) < len(key) + 40 for t in tokens[1000 + i]) for i, (_, key) in enumerate(made)) >= 18, tokens
    assert min(tokens) >= 1000
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert sum(key[11:] in clean[1000 + i] for i, (_, key) in enumerate(made)) <= 2


ORDINARY = "FREQUENTLYASKEDQUESTIONS TERMSANDCONDITIONSAPPLY INTERNATIONALBUSINESS CUSTOMERSERVICECENTER PROFESSIONALDEVELOPMENT ENVIRONMENTALPROTECTION getElementsByClassName XMLHttpRequestEventTarget AbstractSingletonProxyFactoryBean 6126142746547109 https://www.example.com/some/very/long/path/to/a/page.html".split()


def test_ordinary_words_are_no_secrets(spark):
    rng = random.Random(7)
    prose = [(i, words(300, i, 4)) for i in range(1500)]
    docs = table(spark, prose + [(5000 + i, f"see {w} there, or {w.lower()}") for i, w in enumerate(ORDINARY)] + [(9000, "".join(rng.choices("0123456789abcdef", k=40)))])
    assert {r["doc_id"] for r in secrets.find_secrets(docs).collect()} == {9000}


def plain_log_e(token: str, counts: Counter) -> float:
    """Log e-value of a whole run of one encoding, character by character."""
    fold = "abcdefghijklmnopqrstuvwxyz0123456789+/_-"
    encoding = next(e for e, symbols in secrets.ENCODINGS.items() if set(token) <= set(symbols))
    single = np.array([sum(n for (_, b), n in counts.items() if b == c) + 1.0 for c in fold])
    single /= single.sum()

    def log_pair(a, b):
        row = np.array([counts[a, c] for c in fold]) + 10 * single
        return np.log(row[fold.index(b)] / row.sum())

    chain = list(zip([None, *token.lower()], token.lower()))
    own = sum(log_pair(a, b) for a, b in chain)
    code = lambda c: 40 if c is None else fold.index(c)
    common = sum(secrets._COMMON_PAIR[code(a), code(b)] for a, b in chain)
    cases = [c.isupper() for c in token if c.isalpha()]
    changed = [a != b for a, b in zip(cases, cases[1:])]
    case = np.log(np.mean([np.prod([p if c else 1 - p for c in changed]) for p in secrets.CASE_CHANGES]) / 2) if cases else 0.0
    return -len(token) * np.log(len(secrets.ENCODINGS[encoding])) - (np.logaddexp(own, common) - np.log(2)) - case - np.log(len(secrets.ENCODINGS))


def test_e_values_and_level_equal_plain_loops(spark):
    rng = random.Random(12)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=24)) for _ in range(5)] + ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(5)]
    rows = [(i, words(50, i, 6) + " Capital WORDS in 2024") for i in range(50)] + [(100 + i, "key " + k) for i, k in enumerate(keys)]
    counts: Counter = Counter()
    for _, t in rows:
        for token in t.split():
            if len(token) < secrets.MIN_LENGTH:
                counts.update(zip([None, *token.lower()], token.lower()))
    found = {r["token"]: r for r in secrets.find_secrets(table(spark, rows)).collect()}
    assert set(found) == set(keys)
    for k in keys:
        assert found[k]["log10_e"] == pytest.approx(plain_log_e(k, counts) / np.log(10), abs=1e-6)
        assert found[k]["p_random"] == secrets.battery(k, found[k]["encoding"])[3] >= secrets.LEAST_RANDOM


def test_discoveries_are_those_of_the_rule():
    rng = np.random.default_rng(1)
    for _ in range(50):
        tokens = int(rng.integers(10, 500))
        places = np.floor(rng.exponential(30, size=int(rng.integers(0, tokens)))).astype(int)
        e = np.sort(np.exp(places / 8))[::-1]
        k = max((i + 1 for i in range(len(e)) if e[i] >= tokens / (0.01 * (i + 1)) * (1 - 1e-12)), default=0)
        level = secrets.level_of(Counter(places.tolist()), tokens, 0.01)
        assert sum(p / 8 >= level for p in places) == k


# SimHash


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows, groups = [], {}
    for g in range(30):
        base = words(400, g).split()
        for c in range(3):
            copy = list(base)
            for _ in range(c * 3):
                copy[rng.randrange(400)] = "changed"
            groups[g * 10 + c] = g * 10
            rows.append((g * 10 + c, " ".join(copy)))
    rows += [(5000 + i, "one text that is there a thousand times") for i in range(1000)]
    found = {r["doc_id"]: (r["kept_id"], r["copies"]) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert all(found[d] == (k, 3) for d, k in groups.items() if d != k)
    assert not any(k in found for k in groups.values())
    assert all(found[5000 + i] == (5000, 1000) for i in range(1, 1000))


@pytest.mark.parametrize("most", [simhash.MOST_BROADCAST, 0])
def test_near_edges_equal_all_pairs_within_the_radius(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
    rows = []
    for g in range(40):
        base = words(120, 100 + g).split()
        rows += [(g * 100 + c, " ".join(base[: 120 - c * 2] + ["w%d" % c])) for c in range(12)]
    sigs = simhash.signatures(table(spark, rows)).withColumnRenamed("doc_id", "node").cache()
    plain = {r["node"]: [r[f"s{i}"] & (2**64 - 1) for i in range(4)] for r in sigs.collect()}
    near = {(a, b) for a in plain for b in plain if a < b and sum((x ^ y).bit_count() for x, y in zip(plain[a], plain[b])) <= simhash.RADIUS}

    def roots(edges):
        up = {d: d for d in plain}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return {d: find(d) for d in plain}

    expected = roots(near)
    for block_rows in (simhash.BLOCK_ROWS, 7):
        found = roots((r["a"], r["b"]) for r in simhash.near_edges(sigs, block_rows=block_rows).collect())
        same = sum(found[a] == found[b] for a, b in near)
        assert same >= 0.97 * len(near)
        assert all(expected[d] == expected[found[d]] for d in plain)


@pytest.mark.parametrize("distance", [20, 36, simhash.RADIUS])
def test_groups_of_two_near_the_radius_meet(spark, distance):
    rng = random.Random(distance)
    rows = []
    for g in range(1000):
        base = rng.getrandbits(256)
        for c, bits in enumerate((base, base ^ sum(1 << b for b in rng.sample(range(256), distance)))):
            words = [bits >> 64 * w & (2**64 - 1) for w in range(4)]
            rows.append((2 * g + c, *(w - 2**64 if w >> 63 else w for w in words)))
    sigs = spark.createDataFrame(rows, "node long, s0 long, s1 long, s2 long, s3 long")
    met = {tuple(sorted((r["a"], r["b"]))) for r in simhash.near_edges(sigs).collect()}
    assert met <= {(2 * g, 2 * g + 1) for g in range(1000)}
    # a thousand pairs at the chance promised are ten less at times
    assert len(met) >= 1000 * simhash.RECALL - 12, len(met)


def test_bands_follow_the_number_of_signatures():
    for rows in (0, 1, 10**6, 10**9, 10**11):
        bands, bits = simhash.bands_for(rows)
        meet = (1 - simhash.RADIUS / 256) ** bits
        assert bits >= 16 and rows / 2**bits <= simhash.BUCKET_ROWS and 1 - (1 - meet) ** bands >= simhash.RECALL


def test_near_duplicates_of_odd_documents(spark, odd, empty):
    found = {r["doc_id"]: r["kept_id"] for r in simhash.near_duplicates(odd).collect()}
    assert found == {3: 2}
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(odd).collect())
    assert kept == Counter(set(ODD)) - Counter([(3, "  \n\t ")])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


# importance resampling


def test_importance_sample(spark, odd, empty, labels, no_labels):
    good, bad = [words(100, i % 5) for i in range(40)], [words(100, 50 + i % 5) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    known = spark.createDataFrame([(i, int(i < 40), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    sample = importance.importance_sample(table(spark, rows), known).collect()
    assert len(sample) == 40 and all(r["doc_id"] < 40 for r in sample)
    assert all(abs(r["gumbel_key"] - r["log_weight"] - importance.gumbel(np.array([r["doc_id"]]), 17)[0]) < 1e-6 for r in sample)
    assert {r["doc_id"] for r in importance.importance_sample(odd, no_labels).collect()} == {2, 3, 4, 5, 6}
    assert importance.importance_sample(odd, labels, fraction=0.5).count() == 3
    assert importance.importance_sample(empty, labels).count() == 0


def test_log_weights_equal_plain_counts(spark):
    rows = [(i, f"{words(3 + i % 9, i % 7, 2)} ... {words(4, i % 5, 3)}!") for i in range(60)] + [(60, "")]
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int")

    def buckets(text):
        from docwarden.llm.textkernels import _BYTE_CODES, _MULT, mix

        import re

        code = lambda raw: int(mix(np.array([sum(int(_BYTE_CODES[b]) * pow(_MULT, i, 1 << 64) for i, b in enumerate(raw)) % (1 << 64)], dtype=np.uint64))[0])
        hashes = [code(w.encode()) for w in re.findall(r"[^\W_]+|[^\w\s]+", text)]
        pairs = [int(mix(np.array([(a * _MULT + b) % (1 << 64)], dtype=np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
        return [h % importance.BUCKETS for h in hashes + pairs]

    good, raw = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i < 40 and i % 4 == 0:
            good.update(buckets(t))
    share = lambda counts, b: (counts[b] + 1) / (sum(counts.values()) + importance.BUCKETS)
    expected = {i: sum(np.log(share(good, b) / share(raw, b)) for b in buckets(t)) for i, t in rows}
    found = {r["doc_id"]: r["log_weight"] for r in importance.importance_sample(table(spark, rows), known, fraction=1.0).collect()}
    assert found == pytest.approx(expected, abs=1e-5)


def test_importance_ties_go_to_the_least_id_and_repeated_rows_are_drawn_apart(spark):
    scores = spark.createDataFrame([(i, 1.0) for i in range(50)], "doc_id long, gumbel_key double")
    assert sorted(r["doc_id"] for r in importance.greatest(scores, 7).collect()) == list(range(7))
    twice = table(spark, [(1, "a b"), (1, "a b"), (2, "c d"), (3, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r["doc_id"] for r in importance.importance_sample(twice, labels).collect()) == [1, 1, 2]


def test_greatest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(importance, "_EXACT_BELOW", 20)
    rng = np.random.default_rng(3)
    keys = np.round(rng.normal(size=2000), 1)
    scores = spark.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "doc_id long, gumbel_key double")
    for k in (0, 1, 333, 1999, 5000):
        expected = sorted(range(2000), key=lambda i: (-keys[i], i))[:k]
        assert sorted(r["doc_id"] for r in importance.greatest(scores, k).collect()) == sorted(expected)


# repeated passages


def brute_passages(rows, n):
    seen, places = {}, defaultdict(list)
    for d, t in sorted(dict((d, t) for d, t in sorted(rows, key=repr) if d is not None and t is not None).items()):
        w = t.split()
        for p in range(len(w) - n + 1):
            places[tuple(w[p : p + n])].append((d, p))
    kept, gone = set(), set()
    for where in places.values():
        if len(where) > 1:
            for nth, (d, p) in enumerate(sorted(where)):
                (gone if nth else kept).update((d, x) for x in range(p, p + n))
    return kept, gone - kept


@pytest.mark.parametrize("seed, crowd", [(0, 4096), (1, 4096), (2, 4096), (3, 4096), (0, 0), (1, 0)])
def test_passages_equal_brute_force(spark, monkeypatch, seed, crowd):
    # with crowds of none, every anchor that is sampled twice is taken apart
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "CROWD_SHARE", 0.0 if not crowd else repeats.CROWD_SHARE)
    rng = random.Random(seed)
    shared = [words(rng.randint(8, 40), 70 + i, 2).split() for i in range(6)]
    rows = []
    for d in range(40):
        text: list[str] = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(shared) if rng.random() < 0.6 else words(rng.randint(1, 30), rng.randrange(10**6), 2).split()
        rows.append((d, " ".join(text)))
    rows.append((99, " ".join(["a"] * 200)))
    found_kept, found_cut = set(), set()
    for r in repeats.repeated_passages(table(spark, rows), min_words=10, anchor_words=4).collect():
        (found_cut if r["is_cut"] else found_kept).update((r["doc_id"], x) for x in range(r["start_word"], r["end_word"]))
    assert (found_kept, found_cut) == brute_passages(rows, 10)


def test_an_anchor_of_very_many_contexts(spark):
    shared, other = words(40, 5, 3), words(55, 6, 3)
    rows = [(i, f"{words(12, i, 9)} {shared if i % 3 else other} {words(12, 10**6 + i, 9)}") for i in range(100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    known, _ = repeats._distinct(docs)
    assert repeats.crowded_anchors(known, 50, 25)
    found = repeats.repeated_passages(docs).collect()
    # 40 shared words are no passage; of 55 the first document keeps its own
    cut_ids = {r["doc_id"] for r in found if r["is_cut"]}
    assert cut_ids == {i for i in range(3, 100_000, 3)} and {r["doc_id"] for r in found if not r["is_cut"]} == {0}
    assert {(r["start_word"], r["end_word"]) for r in found} == {(12, 67)}


def test_cut_repeats(spark, odd, empty):
    passage = words(70, 5)
    rows = [(1, "first " + passage + " end"), (2, "second  " + passage + " tail"), (3, "clean one"), (4, LONG), (5, LONG)]
    out = {r["doc_id"]: r for r in repeats.cut_repeats(table(spark, rows)).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "second  tail" and out[3]["text"] == "clean one" and out[4]["text"] == LONG and out[5]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in repeats.cut_repeats(odd).collect()))) == sorted(map(repr, ODD))
    assert repeats.repeated_passages(empty).count() == 0 and repeats.cut_repeats(empty).count() == 0


# toxicity


def test_toxicity(spark, odd, empty, labels, no_labels):
    rows = [(1, "You are an idiot."), (2, "You are not an idiot."), (3, "Fine day."), (None, "du bist ein Trottel"), (4, None), (5, ""), (3, "Fine day."), (6, LONG + ". you idiot"), (7, "¡Eres un IMBÉCIL!"), (1, "You are an idiot.")]
    found = Counter((r["doc_id"], r["score"]) for r in toxicity.toxic_documents(table(spark, rows), no_labels).collect())
    assert found == Counter({(1, 1.5): 2, (None, 1.5): 1, (6, 1.5): 1, (7, 1.5): 1})
    kept = Counter((r["doc_id"], r["text"]) for r in toxicity.drop_toxic(table(spark, rows), no_labels).collect())
    assert kept == Counter(r for r in rows if r[0] in (2, 3, 4, 5))
    assert Counter((r["doc_id"], r["text"]) for r in toxicity.drop_toxic(odd, labels).collect()) == Counter(ODD)
    assert toxicity.toxic_documents(empty, labels).count() == 0 and toxicity.drop_toxic(empty, labels).count() == 0


CLEAN = ["the stupid door is broken", "take out the trash", "i will beat you at chess", "these prices will kill the competition and hurt them", "he is taking the trash out", "he said you are an idiot", "you are not such an idiot", "i will not kill you", "dad will kill me", "they threw their trash away"]
TOXIC = ["you idiot", "They are all disgusting morons!", "I will kill you", "I'll come to your house and kill you", "kill yourself", "I will beat you up", "idiots like you", "I said you are a clown", "tu es un abruti", "kill that idiot. nothing but scum here. what a worthless loser"]


@pytest.mark.parametrize("text", CLEAN + TOXIC)
def test_clauses_decide_and_words_don_t(text):
    import pyarrow as pa

    assert bool(list(toxicity.Lexicon().verdicts(pa.array([text]), toxicity.THRESHOLD))) == (text in TOXIC)


def plain_verdict(text: str, stems: dict[str, float]) -> tuple[float, float, int] | None:
    """Score, total and clauses of a text, by plain loops over sentences, words and the five machines one after the other."""
    import re

    machines = toxicity_machines()
    scores = []
    for sentence in re.split(r"[.!?;\n\r]", text.lower()):
        states, aimed, bare = [m.start for m in machines], 0.0, 0.0
        for word in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", sentence):
            kind, factor = toxicity._CLASS_OF.get(word), 1.0
            if kind is None:
                stem = max((s for s in stems if word.startswith(s)), key=len, default=None)
                kind, factor = ("INSULT", stems[stem]) if stem else ("OTHER", 1.0)
            symbol, weight = kind, 0.0
            for i, machine in enumerate(machines):
                states[i], symbol, w = machine.step(states[i], symbol)
                weight += w
            if kind == "INSULT" and weight == toxicity.BARE:
                bare += weight * factor
            else:
                aimed += weight * factor
        hostile = any(toxicity._CLASS_OF.get(w) in toxicity._HOSTILE or w.startswith(tuple(stems)) for w in re.findall(r"[^\W\d_]+", sentence))
        if aimed + bare and hostile:
            scores.append((round(aimed + min(bare, toxicity.BARE), 6), round(aimed + bare, 6)))
    n = len(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower()))
    total = round(sum(t for _, t in scores), 6)
    if scores and (max(s for s, _ in scores) >= 1 or total >= max(1, toxicity.DENSITY * n)):
        return max(s for s, _ in scores), total, len(scores)
    return None


def toxicity_machines():
    """The five machines as the grammar composes them."""
    made = []
    real = toxicity.compose
    try:
        toxicity.compose = lambda machines, symbols: made.append(machines) or real(machines, symbols)
        toxicity.grammar()
    finally:
        toxicity.compose = real
    return made[0]


def test_verdicts_equal_plain_loops():
    import pyarrow as pa

    rng = random.Random(3)
    stems = {"zor": 0.8, "zorgh": 1.0, "ñoñ": 0.7}
    pool = [w for group in toxicity._WORDS.values() for w in group.split()] + ["zorghen", "zorro", "ñoñería", "house", "tree", "été", "killing", "it", "7"] * 6
    texts = ["".join(rng.choice(pool).upper() + rng.choice([" ", " ", " ", ", ", ". ", "\n", "! ", " ¡", "'"]) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["", None, "you idiot"]
    found = {row: (score, total, n) for row, score, total, n, _ in toxicity.Lexicon(stems).verdicts(pa.array(texts), 1.0)}
    expected = {i: v for i, t in enumerate(texts) if t is not None and (v := plain_verdict(t, stems))}
    assert found == expected and len(found) > 100


def test_a_very_long_line_is_scored_in_linear_time():
    import time

    import pyarrow as pa

    began = time.perf_counter()
    (row,) = toxicity.Lexicon().verdicts(pa.array(["the stupid door is broken and " * 270_000 + ". you idiot"]), 1.0)
    assert row[1:4] == (1.5, 135_001.5, 2) and time.perf_counter() - began < 60


def test_toxic_words_are_learned(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        text = words(60, i, 4).split()
        if i % 5 == 0:
            for _ in range(3):
                text.insert(rng.randrange(60), "zorgh" + rng.choice(["en", "ly", "ed"]))
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(i % 5 == 0)))
    seen = spark.createDataFrame([m for m in marks if m[0] % 2], "doc_id long, quality int, toxic int")
    found = {r["doc_id"] for r in toxicity.toxic_documents(table(spark, rows), seen).collect()}
    assert found == {i for i, _, t in marks if t}


def test_rare_toxic_labels_are_learned_from(spark):
    toxic = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} blargle {chr(97 + i % 26)}q{chr(97 + i // 26)}") for i in range(60)]
    plain = spark.range(1000, 101_000).selectExpr("id as doc_id", "concat('plain ', translate(cast(id as string), '0123456789', 'abcdefghij'), ' words here') as text")
    docs = spark.createDataFrame(toxic, "doc_id long, text string").unionByName(plain)
    known = docs.selectExpr("doc_id", "cast(doc_id < 1000 as int) as toxic")
    # 180 rows: a third is 60, so every toxic row is in the sample
    assert any("blargle".startswith(s) for s in toxicity.learn_stems(docs, known, sample_rows=180))


def test_toxicity_on_held_out_labels(spark):
    # no constant was chosen on these labels
    docs, marks = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs, marks.filter("doc_id % 2 = 0")).collect()}
    held = {r["doc_id"]: r["toxic"] for r in marks.filter("doc_id % 2 = 1").collect()}
    bad = [d for d in held if held[d] == 1]
    good = [d for d in held if held[d] == 0]
    assert sum(d in found for d in bad) >= 0.95 * len(bad)
    assert sum(d in found for d in good) <= 0.002 * len(good)

"""Algorithms of the corpus operators against brute force, without Spark."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docwarden.llm import bitslice, bpe, lyndon, matroska, packing, repeats, secrets, simhash, toxicity, warc


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array_equals_sorted_suffixes(text):
    order = lyndon.suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = lyndon.common_prefixes(text, order)
    for r in range(1, len(text)):
        a, b = text[order[r - 1] :], text[order[r] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[r] == n


def test_resolve_keeps_first_occurrences():
    assert repeats.resolve([(0, 60, True), (50, 110, False)]) == [(0, 50, True), (50, 110, False)]
    assert repeats.resolve([]) == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 300])
@pytest.mark.parametrize("radius", [0, 3, 40])
def test_bit_sliced_pairs_equal_brute_force(n, radius):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (max(1, n // 10), 4), dtype=np.uint64)
    sigs = base[rng.integers(0, len(base), n)].copy()
    for i in range(n):
        for _ in range(rng.integers(0, 50)):
            sigs[i, rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    near = lambda i, j: sum(int(x).bit_count() for x in sigs[i] ^ sigs[j]) <= radius
    expected = {(i, j) for i in range(n) for j in range(i + 1, n) if near(i, j)}
    a, b = bitslice.block_pairs(sigs, sigs, radius, same=True)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())} == expected
    if n:
        i, j = bitslice.near_in_runs(sigs, np.arange(n)[::-1].copy(), radius)
        assert {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())} == expected


def test_short_runs_are_compared_at_a_small_cost_a_pair():
    # as the buckets of a corpus of some gigabytes: many lengths, unlike rows
    rng = np.random.default_rng(4)
    sizes = rng.geometric(1 / 12, 1500)
    sigs = rng.integers(0, 1 << 63, (int(sizes.sum()), 4), dtype=np.uint64)
    left = np.concatenate([np.arange(n)[::-1] for n in sizes])
    began = time.process_time()
    i, _ = bitslice.near_in_runs(sigs, left, 40)
    assert time.process_time() - began < 3e-7 * left.sum() and not len(i)


@pytest.mark.parametrize("n", [1, 70, 700])
@pytest.mark.parametrize("first", [None, 0, 30])
def test_crowded_buckets_are_joined_as_all_pairs_join_them(n, first):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (max(1, n // 60), 4), dtype=np.uint64)
    sigs = base[rng.integers(0, len(base), n)].copy()
    for i in range(n):
        for _ in range(rng.integers(0, 45)):
            sigs[i, rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    near = np.bitwise_count(sigs[:, None] ^ sigs[None]).sum(axis=2) <= 40
    counted = np.triu(near, 1)
    if first is not None:
        counted[:first, :first] = counted[first:, first:] = False
    a, b = simhash.linked(sigs, 40, first)

    def labels(x, y):
        return simhash._merged(np.arange(n), np.asarray(x, dtype=int), np.asarray(y, dtype=int))

    found, wanted, most = labels(a, b), labels(*np.nonzero(counted)), labels(*np.nonzero(np.triu(near, 1)))
    assert len(a) == n - len(np.unique(found))
    if first is None:
        assert np.array_equal(found, wanted)
    # with a first part no wanted pair is apart, and none is joined that isn't by near ones
    x, y = np.nonzero(counted)
    assert np.array_equal(found[x], found[y]) and np.array_equal(most[found], most)


def test_rows_that_a_star_has_joined_are_not_compared(monkeypatch):
    rng = np.random.default_rng(8)
    sigs = np.repeat(rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64), 3000, axis=0)
    sigs[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    listed = []
    parts = bitslice.block_parts
    monkeypatch.setattr(simhash, "block_parts", lambda *a: (listed.append(len(p[0])) or p for p in parts(*a)))
    a, b = simhash.linked(sigs, 40)
    assert len(a) == 2999 and set(b) == {0} and not listed


def test_packing_rule_equals_brute_force():
    rng = np.random.default_rng(3)
    capacity = 20
    fast, gaps = packing.SumOfSquares(capacity), []
    for size in rng.integers(1, capacity + 1, 400).tolist():
        count = np.bincount(gaps, minlength=capacity + 1)
        count[0] = 0

        def cost(gap: int, size=size, count=count) -> int:
            after = count.copy()
            if gap <= capacity:
                after[gap] -= 1
            rest = (gap if gap <= capacity else capacity) - size
            if rest:
                after[rest] += 1
            return int((after**2).sum())

        options = [g for g in range(size, capacity + 1) if count[g]] + [capacity + 1]
        least = min(map(cost, options))
        chosen = fast.choose(size)
        assert chosen in options and cost(chosen) == least
        fast.place(size)
        if chosen <= capacity:
            gaps.remove(chosen)
        rest = (chosen if chosen <= capacity else capacity) - size
        if rest:
            gaps.append(rest)
        assert np.array_equal(np.bincount(gaps, minlength=capacity + 1), fast.open)


@given(st.lists(st.integers(0, 2**31 - 1), max_size=80))
@settings(max_examples=100, deadline=None)
def test_varints_round_trip(values):
    assert bpe._from_varints(bpe._varints(np.array(values, dtype=np.int64))).tolist() == values


def test_varints_cross_slices(monkeypatch):
    monkeypatch.setattr(bpe, "_SLICE", 7)
    values = np.random.default_rng(1).integers(0, 1 << 20, 500)
    assert np.array_equal(bpe._from_varints(bpe._varints(values)), values)


def test_merging_equals_the_public_encoder():
    ranks = bpe.read_ranks()
    encoder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ["a", " hello", "überraschung" * 9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "你好", "x" * 999]:
        assert bpe.merge_word(word.encode(), ranks) == encoder._encode_single_piece(word.encode())


@pytest.mark.parametrize("lacing", ["none", "xiph", "ebml", "fixed"])
@pytest.mark.parametrize("live", [False, True])
def test_media_round_trip(lacing, live):
    frames = [b"abcd"] if lacing == "none" else [b"abcd", b"efgh", b"ijkl"] if lacing == "fixed" else [b"a" * 300, b"", b"bc" * 40, b"z"]
    if lacing == "ebml":
        frames = [b"a" * 300, b"b" * 5, b"c" * 200, b"z"]
    tracks = [_track(1)]
    data = matroska.write_media(tracks, [(1, 0, frames, lacing, True), (1, 9000, [b"end"], "none", True)], live=live)
    rows = list(matroska._packet_rows(7, data))
    offsets = [(r[5], r[6]) for r in rows]
    assert [data[o : o + n] for o, n in offsets] == [*frames, b"end"]
    assert all(r[-1] for r in rows)
    assert rows[-1][4] == 9_000_000_000
    cut = list(matroska._packet_rows(7, data[:-2]))
    assert len(cut) <= len(rows) and not any(r[-1] for r in cut)
    assert list(matroska._packet_rows(7, b"no media")) == []


def test_media_assembled_by_hand():
    """Bytes as the format's specification gives them, none made by the module's own writer."""
    void = bytes.fromhex("ec83000000")
    crc = bytes.fromhex("bf8401020304")
    head = bytes.fromhex("1a45dfa3 8b 4282 88 6d6174726f736b61")
    info = bytes.fromhex("1549a966 4007 2ad7b1 83 0f4240")
    track = bytes.fromhex("ae 8b d7 81 01 83 81 11 86 83 565f58")
    tracks = bytes.fromhex("1654ae6b") + bytes([0x80 | len(track)]) + track
    # group: a key frame of 20 ms, and one that refers to it (-20) with three frames in Xiph lacing (2, 1 and the rest)
    first = bytes.fromhex("a0 8b a1 86 81 0014 00 aabb 9b 81 14")
    second = bytes.fromhex("a0 91 a1 8c 81 0028 02 02 02 01 1111 22 3333 fb 81 ec")
    body = crc + bytes.fromhex("e7 81 64") + void + first + second
    cluster = bytes.fromhex("1f43b675") + b"\x40" + bytes([len(body)]) + body
    content = info + void + tracks + cluster
    data = head + bytes.fromhex("18538067") + b"\x10\x00\x00" + bytes([len(content)]) + content
    rows = list(matroska._packet_rows(1, data))
    assert [data[r[5] : r[5] + r[6]].hex() for r in rows] == ["aabb", "1111", "22", "3333"]
    assert [(r[2], r[3], r[4], r[7], r[8], r[9]) for r in rows] == [(1, "V_X", 120_000_000, "none", 0, True), (1, "V_X", 140_000_000, "xiph", 0, False), (1, "V_X", None, "xiph", 1, False), (1, "V_X", None, "xiph", 2, False)]
    assert all(r[-1] for r in rows)


def test_live_streams_end_to_end():
    one = matroska.write_media([_track(1)], [(1, 0, [b"first"], "none", True), (1, 9000, [b"second"], "none", True)], live=True)
    other = matroska.write_media([_track(1)], [(1, 0, [b"third"], "none", True)], live=True)
    data = one + other + one
    rows = list(matroska._packet_rows(1, data))
    assert [data[r[5] : r[5] + r[6]] for r in rows] == [b"first", b"second", b"third", b"first", b"second"] and all(r[-1] for r in rows)


def _track(number: int) -> matroska.Track:
    import dataclasses

    given = {"number": number, "kind": 17, "codec": "S_TEXT/UTF8"}
    return matroska.Track(**{f.name: given[f.name] for f in dataclasses.fields(matroska.Track) if f.name in given})


def test_byte_ranges_coalesce():
    assert warc.ranges([(0, 10), (12, 5), (100, 5)], gap=4) == [(0, 17, 2), (100, 105, 1)]
    assert warc.ranges([], gap=4) == []


def plain_battery(token: str, encoding: str) -> tuple[float, float, float]:
    """Chi-squared, changes about the middle and sum of products of neighbours, symbol by symbol."""
    place = {c: i for i, c in enumerate(secrets.ENCODINGS[encoding])}
    values, k = [place[c] for c in token], len(place)
    cells = max(2, min(k, len(values) // 2))
    counts, shares = [0] * cells, [0.0] * cells
    for v in values:
        counts[v * cells // k] += 1
    for v in range(k):
        shares[v * cells // k] += 1 / k
    high = [v >= k / 2 for v in values]
    chi = sum((c - len(values) * s) ** 2 / (len(values) * s) for c, s in zip(counts, shares))
    return chi, sum(a != b for a, b in zip(high, high[1:])), sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(values, values[1:]))


@pytest.mark.parametrize("encoding", ["hex", "base62", "mixed"])
def test_battery_of_any_span_is_that_of_its_own_symbols(encoding):
    rng = np.random.default_rng(6)
    symbols = secrets.ENCODINGS[encoding]
    text = "".join(rng.choice(list(symbols), 6000))
    whole = np.frombuffer(text.encode(), dtype=np.uint8)
    where, counted = secrets._symbols(whole, 0, len(whole), secrets._NAMES.index(encoding))
    for lo, hi in [(0, 6000), (0, 16), (5984, 6000), (17, 5000), (100, 200)]:
        found = counted.battery(lo, hi)
        assert found == secrets.battery(text[lo:hi], encoding)
        chi, changes, products = plain_battery(text[lo:hi], encoding)
        n, k = hi - lo, len(symbols)
        cells = max(2, min(k, n // 2))
        assert found[0] == pytest.approx(secrets._gamma_tail((cells - 1) / 2, chi / 2))
        assert int(counted.changes[hi - 1] - counted.changes[lo]) == changes
        assert found[2] == pytest.approx(math.erfc(abs(products) / ((k * k - 1) / 12 * math.sqrt(n - 1)) / math.sqrt(2)))


def test_long_runs_of_many_separators_take_time_by_their_length():
    # each of 20,000 parts behind a separator reaches the level and fails the battery
    rng = np.random.default_rng(7)
    few = np.where(np.arange(26) % 2, rng.choice(list("qz"), (20_000, 26)), rng.choice(list("XJ"), (20_000, 26)))
    text = "/".join("".join(x) for x in few)
    model = secrets.Background(secrets.pair_model(np.zeros((41, 40))), 20.0, 5.0)
    assert all(np.sum(weighted >= model.level) > 20_000 for *_, weighted in secrets._candidates(pa.array([text]), model))
    began = time.process_time()
    assert not list(secrets._found(pa.array([text]), model))
    assert time.process_time() - began < 60


def test_battery_tells_random_from_regular():
    rng = np.random.default_rng(5)
    passed = sum(secrets.battery("".join(rng.choice(list("0123456789abcdef"), 40)), "hex")[3] >= secrets.LEAST_RANDOM for _ in range(300))
    assert passed >= 297
    assert secrets.battery("0123456789abcdef" * 3, "hex")[3] < secrets.LEAST_RANDOM
    assert secrets.battery("a" * 40, "hex")[3] < secrets.LEAST_RANDOM
    assert secrets._gamma_tail(3.0, 5.0) == pytest.approx(math.exp(-5) * (1 + 5 + 12.5), rel=1e-9)


@pytest.mark.parametrize(
    "clause,toxic",
    [
        ("you are an idiot", True),
        ("what an idiot", False),
        ("you are not an idiot", False),
        ("never stupid", False),
        ("she said idiot", False),
        ("i will kill you", True),
        ("they kill time", False),
        ("to kill the process", False),
        ("i will not kill you", False),
        ("the weather is fine", False),
        ("", False),
    ],
)
def test_grammar(clause, toxic):
    assert (toxicity.Lexicon().clause_score(clause)[0] >= toxicity.THRESHOLD) == toxic


def test_clauses_don_t_leak():
    found = list(toxicity.Lexicon().matches(pa.array(["He is not. An idiot!\nnothing", "", None, "scum"])))
    assert found == [(0, 0.5, 0.5, "an idiot", 6), (3, 0.5, 0.5, "scum", 1)]

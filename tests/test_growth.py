"""What keeps the queries' time and memory from growing faster than their tables."""

from __future__ import annotations

import pytest
import yaml
from conftest import SF_DIR
from pyspark.sql import functions as F

from docwarden.config import Config
from docwarden.functions.text import entropies
from docwarden.plans import across, catalogue, parse, sheets
from docwarden.plans.scan import to_findings


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 20,000 customers in one file and row group."""
    folder = str(tmp_path_factory.mktemp("many"))
    one = spark.range(20000, numPartitions=1)
    one.select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("MACHINERY").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    return folder


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("composed", [sheets.sheets, catalogue.cards])
def test_small_rows_of_one_file_are_dealt_to_tasks(spark, many, composed):
    docs = composed(spark, many)
    assert docs.rdd.getNumPartitions() == 3
    assert docs.select("path").distinct().count() == 20000


def test_front_matter_is_what_safe_load_gives(monkeypatch):
    texts = [
        "name: tool-1\ndescription: some sheet 1\nrequires:\n  mcp: [files, mail]", 'a: ""\nb:\n  c: []\nd: yes\ne: 2020-01-01\nf: 1.5\ng: null\nh: 0x1F', f"command: p{chr(0x430)}ypal-job", "a: b\na: c", " a: b\nc: d", "a:\n  b: c\n d: e",
        "a: 'b'", "a: b # c", "a: b: c", "- a\n- b", "a: [b", "a: {b: c}", "a: |\n  b", "a:\tb", "", "just words", "a: *b", f"name: {chr(0x1F600)}",
    ]

    def result(text):
        try:
            return repr(parse._load(text))
        except yaml.YAMLError as error:
            return str(error)

    quick = [result(t) for t in texts]
    known = [bool(parse._SIMPLE.fullmatch(parse._LETTERS.sub("a", t))) for t in texts]
    assert known[:3] == [True] * 3 and not any(known[6:14])
    monkeypatch.setattr(parse, "_FAST", None)
    assert quick == [result(t) for t in texts]


def test_names_are_never_broadcast(spark):
    plan = plan_of(sheets.similar_declared_names(spark, SF_DIR))
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    words = spark.createDataFrame([("alpha",), ("alphb",)], "v string")
    assert "Broadcast" not in plan_of(across.near_names(words, words))


def test_few_configured_names_equal_the_join(spark, monkeypatch):
    named = parse.parse(sheets.sheets(spark, SF_DIR)).withColumns({"folder": F.lit("sheets"), "rel_path": F.col("path")})
    (rule,) = catalogue._rules("TYPOSQUAT")
    config = Config(typosquat_baseline=("openai-helper", "OpenAI helper", "stripe-sync", "stripe-synk", "tool-12", "nation-1", "abc", "tool-120x"))
    found = lambda: sorted(tuple(r) for r in catalogue.told(to_findings(across.similar_names(named, rule, config), config)).collect())
    few = found()
    monkeypatch.setattr(across, "_FEW_NAMES", 0)
    assert few and few == found()


def test_nearest_file_without_an_explosion(spark, monkeypatch):
    files = ["/.mcp.json", "/a/.mcp.json", "/a/a.json", "/a/b/c/.mcp.json", "x/.mcp.json", "top"]
    docs = ["/d.md", "/a/d.md", "/a/b/d.md", "/a/b/c/d.md", "/a/b/c/e/f/d.md", "/ab/d.md", "x/y/d.md", "y/d.md", "top", "/a/d.md"]
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else p

    def nearest(path):
        parts = folder(path).split("/")
        above = [[f for f in files if folder(f) == "/".join(parts[:n])] for n in range(len(parts), 0, -1)]
        return next((min(of) for of in above if of), None)

    expected = sorted((d, nearest(d)) for d in set(docs) if nearest(d))
    tables = [spark.createDataFrame([(p,) for p in of], "path string") for of in (docs + [None], files)]
    near = across.nearest_above(*tables)
    assert sorted(tuple(r) for r in near.collect()) == expected
    assert "Generate" not in plan_of(near) and "SortMergeJoin" not in plan_of(near)
    monkeypatch.setattr(across, "_FEW_FILES", 0)
    near = across.nearest_above(*tables)
    assert sorted(tuple(r) for r in near.collect()) == expected
    assert "ShuffledHashJoin" in plan_of(near) and "Broadcast" not in plan_of(near)


def test_servers_are_judged_within_the_row(spark):
    plan = plan_of(sheets.remote_servers(spark, SF_DIR))
    assert "Window" not in plan and plan.count("_front_matter(") == 1


def test_scripts_meet_documents_at_their_depths(spark):
    docs = spark.createDataFrame([("root", "/r/SKILL.md"), ("deep", "/r/a/b/SKILL.md"), ("none", "/r/z/SKILL.md"), ("again", "/r/a/b/X.md")], "skill string, path string")
    paths = [f"/r/{'ab'[i % 2]}/b/s{i:03}.sh" for i in range(400)] + ["/r/a/b/s000.sh", "/q/x.sh", "/r/a/b/t.md", "/r/b/SKILL.md"]
    (rule,) = catalogue._rules("BUNDLED_SCRIPTS")
    found = across.bundled_scripts(docs, spark.createDataFrame([(p,) for p in paths], "path string"), rule, Config())
    scripts = sorted({p for p in paths if p.endswith(".sh") and p.startswith("/r/")})
    below = lambda folder: ", ".join(sorted(p[len(folder) + 1 :] for p in scripts if p.startswith(folder + "/")))[:200]
    assert sorted((r["skill"], r["snippet"]) for r in found.collect()) == [("again", below("/r/a/b")), ("deep", below("/r/a/b")), ("root", below("/r"))]
    # neither documents nor scripts are broadcast, and no list is longer than what is shown of it
    assert not any("BroadcastHashJoin [dir#" in line for line in plan_of(found).splitlines()) and "dense_rank" in plan_of(found)


def test_entropies_are_counted_in_slices():
    import tracemalloc
    from collections import Counter
    from math import log2

    texts = ["", "a", "aabb", "x" * 700_000 + "y" * 700_000] + [f"line {i} of some text that repeats" for i in range(60_000)]
    tracemalloc.start()
    bits = entropies(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bits) == len(texts) and bits[:4] == [0, 0, 1, 1]
    for i in (4, 777, 60_003):
        share = [n / len(texts[i]) for n in Counter(texts[i]).values()]
        assert abs(bits[i] + sum(p * log2(p) for p in share)) < 1e-9
    # all at once would take over 100 MB
    assert peak < 75e6, peak

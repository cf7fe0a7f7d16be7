from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


def same_rows(df, duck, sql: str) -> int:
    """Compares a result with a query's, as multisets of rows with columns by name; gives the number of rows."""
    names = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    theirs = sorted((tuple(_plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert len(mine) == len(theirs), (len(mine), len(theirs), mine[:2], theirs[:2])
    for a, b in zip(mine, theirs):
        assert a == b, (a, b)
    return len(mine)

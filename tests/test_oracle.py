"""Every query with SQL gives the same rows in DuckDB; the others run and keep their columns."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


#: Queries whose rows may repeat.
REPEATS = {"src18_src19_page_sections"}
CORE = {k: f for m in entry.MODULES for k, f in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:  # what can be said without SQL: there are rows, and each once
        assert rows and all(isinstance(c, str) for c in cols)
        assert len(set(map(repr, rows))) == len(rows) or name in REPEATS
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() == 20

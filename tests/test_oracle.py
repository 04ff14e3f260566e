"""Every query with SQL is held against DuckDB over the smallest test data, value by value."""

import datetime
import decimal
import glob
import os

import pytest

import __spark_entry__ as entry

CORE = {n for m in entry.MODULES if ".llm" not in m for n in __import__(m, fromlist=["ORACLE"]).ORACLE}


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_its_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


def test_every_query_has_a_stable_schema(spark, sf):
    assert entry.entry(spark).columns == ["txid", "event_id", "event_type", "event_time", "source_sequence"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query against its DuckDB SQL on the smallest tables."""

import os
import sys
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from blockloom.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, Decimal):
        return v.normalize()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(5).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_no", "value", "n_source", "n_target", "missing", "extra"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

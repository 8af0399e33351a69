"""Every registered query against its SQL twin on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from marketloom import registry

SF = os.environ.get("MARKETLOOM_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got, "no rows"  # tests/test_models.py checks what they hold
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, res.fetchall())

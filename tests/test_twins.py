"""Every query with a SQL twin gives the twin's rows on the smallest tables; the others run."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from cuelake.catalog import core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    rows = core.QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in rows.collect()) if name in core.SQL else rows.count()
    spark.catalog.clearCache()
    if name not in core.SQL:
        return
    got = duck.execute(core.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall())
    assert ours == theirs


def test_every_twin_has_a_query():
    assert set(core.SQL) <= set(core.QUERIES)

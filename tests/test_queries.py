"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from lorebase import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER)
    rows = got.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=str)
    assert a == b


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())

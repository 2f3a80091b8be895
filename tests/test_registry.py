"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())

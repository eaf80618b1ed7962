"""Registered queries against their SQL, on the small tables."""

import duckdb
import pytest

from riskweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, db, name):
    frame = registry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in frame.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    other = db.sql(sql)
    assert sorted(other.columns) == names
    assert sorted(repr(tuple(r[other.columns.index(c)] for c in names)) for r in other.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 7
    assert set(entry.oracle_sql()) <= set(entry.queries())

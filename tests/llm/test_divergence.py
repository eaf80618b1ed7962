"""The source divergence audit against its SQL on rows that pin the edges."""

import duckdb
import pytest

from riskweave.llm import divergence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def told(frame):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in frame.collect())


def by_sql(rows):
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    out = db.sql(divergence.ORACLE)
    return sorted(repr(tuple(r[out.columns.index(c)] for c in COLUMNS)) for r in out.fetchall())


def corpus():
    rows = []
    for k in range(60):
        rows.append(("en", f"s{k % 4}", f"The cat-{k % 7} sat, on The mat. {'dog ' * (k % 5)} don't stop ÀB{k % 3}"))
        rows.append(("de", f"s{k % 3}", f"Straße straße, STRAßE. {'und ' * (k % 4)} x{k}y"))
    # One term through many rare chunks: ten documents in all, and nine.
    rows += [("en", "s1", f"rare{k}( one") for k in range(5)] + [("en", "s2", f"rare.{k} two") for k in range(5)]
    rows += [("en", "s0", "twice! twice? twice twice; " * 3)] * 9 + [("fr", "a", f"neuf_{k}") for k in range(9)] + [("fr", "b", "neuf!")]
    rows += [(None, None, None), (None, "s0", "x"), ("en", None, ""), ("xx", "only", "1 2 3"), ("", "s9", "x")]
    rows += [("en", "s3", "a" * 50_000 + " " + "the. " * 20_000), ("en", "s3", "the" + ",the" * 20_000)]
    return rows


@pytest.mark.parametrize("block", [2, 64])
def test_same_as_sql(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)  # several blocks of sources, or one
    rows = corpus()
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    got = told(divergence.divergence(frame))
    assert got == by_sql(rows) and len(got) > 40
    if block == 64:
        monkeypatch.setattr(divergence, "UNIT", 2_000)  # documents of a language in many units
        assert told(divergence.divergence(frame)) == got


def test_edges(spark):
    schema = "lang string, source string, text string"
    assert told(divergence.divergence(spark.createDataFrame([], schema))) == []
    few = [("en", "a", "hello"), ("en", "b", None), ("en", "b", "hello")]  # no kept term
    frame = spark.createDataFrame([(*x, 1, "c", 2.0) for x in few], schema + ", code int, chunk string, term double")
    assert told(divergence.divergence(frame)) == by_sql(few) == sorted(repr(("en", *x, 0, 1)) for x in (("a", "pair", "b"), ("b", "pair", "a")))
    rows = [("en", "a", "hello again")] * 30 + [("en", "b", "hello")] * 12  # repeated rows are documents
    assert told(divergence.divergence(spark.createDataFrame(rows, schema))) == by_sql(rows)

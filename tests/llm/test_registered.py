"""Registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from riskweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.queries()[name](spark, SF)
    names = sorted(frame.columns)
    other = db.sql(queries.oracle_sql()[name])
    assert sorted(other.columns) == names
    want = sorted(repr(tuple(r[other.columns.index(c)] for c in names)) for r in other.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in frame.collect()) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen.count()
        seen = corpus_pipeline.written(stage(spark, seen, SF), name)
        assert seen.columns == docs.columns and seen.count() > 0
        if name != "mixture":
            assert seen.count() <= before
    out = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert out.count() == seen.count() and out.where("NOT round_trip").count() == 0

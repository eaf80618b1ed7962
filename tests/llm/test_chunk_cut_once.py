from riskweave.llm import divergence


def test_each_chunk_is_cut_once(spark):
    units = spark.createDataFrame([("en", c, [1], [1], 1, [7]) for c in ("One", "a-b-A", "!!", "b,b")], divergence.COUNTED)
    rows = divergence.chunk_terms(units, 10)
    assert sorted((r["term"], r["k"]) for r in rows.collect()) == [("a", 2), ("b", 1), ("b", 2), ("one", 1)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1

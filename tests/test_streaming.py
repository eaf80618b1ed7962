from riskweave.streaming.candidates import stream_candidates


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "cpf 529.982.247-25 and a@b.org"), (2, None), (3, "529.982.247-26")], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream_candidates(stream, "id", "text").writeStream.format("memory").queryName("candidates").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM candidates").collect()}
    assert got == {tuple(r) for r in stream_candidates(rows, "id", "text").collect()} == {(1, "cpf", "***.***.***-25"), (1, "email", "[email]")}

"""Every document has a row in op2_pieces."""

from riskweave.llm import pieces


def test_null_text_has_a_row(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in pieces.op2_pieces(spark, str(tmp_path)).collect() if r["doc_id"] == 2]
    assert len(rows) == 1 and all(rows[0][c] is None for c in ("sample", "n_pieces", "ids_hash", "log_p", "perturbed", "log_inclusion"))

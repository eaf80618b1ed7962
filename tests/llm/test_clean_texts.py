"""The repeats stage leaves texts alone that lose nothing."""

from riskweave.llm import substrings


def test_clean_texts_keep_their_layout(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    clean = "def f():\n    return  1\n\n\tend\n"
    rows = [(1, clean), (2, passage), (3, f"own\n{passage}\n  rest"), (4, None), (5, " \n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(frame).collect()}
    assert got == {1: clean, 2: passage, 3: "own rest", 4: None, 5: " \n"}
    digests = {r["doc_id"]: r["kept_text"] for r in substrings.dedup_substrings(frame).collect()}
    assert digests[1] == "def f(): return 1 end" and digests[4] == ""

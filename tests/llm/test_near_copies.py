"""The near-copies stage: five words, 80 per cent."""

import corpus_pipeline
from riskweave.llm import jaccard


def test_two_scattered_changes_in_a_hundred_words(spark):
    """86 of 106 shingles of five words (a near copy), 89 of 105 of four (0.848)."""
    base = [f"w{i}" for i in range(100)]
    near = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(base)]
    far = [f"y{i}" if i in (20, 50, 80) else w for i, w in enumerate(base)]  # 81 of 111
    frame = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame, "").collect()) == [1, 3]
    assert jaccard.one_of_each(frame).count() == 3

"""Large blocks of the Jaccard join: what the first two passes leave."""

from pyspark.sql import functions as F

from riskweave.llm import jaccard
from tests.llm.test_operators import brute_components


def changed(words, *places):
    return [f"x{i}" if i in places else w for i, w in enumerate(words)]


def test_one_document_outside_the_main_component(spark, monkeypatch):
    """Copies in two parts, and one edge document whose only partner is no least one and lies in the other part."""
    base = [f"w{i}" for i in range(200)]
    parts = {r["id"]: r["part"] for r in spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("part")).collect()}
    sides = [[i for i in parts if parts[i] == side] for side in (0, 1)]
    core, partner, edge = sides[0][:5] + sides[1][:6], sides[0][4], sides[1][6]
    texts = {d: changed(base, 10 * k + 5) for k, d in enumerate(core)}
    texts[edge] = changed(texts[partner], 130, 150, 170)
    rows = [(d, " ".join(t)) for d, t in texts.items()]
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) == 1
    monkeypatch.setattr(jaccard, "CHUNK", 1200)  # two trees
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(frame).collect()}
    assert got == want

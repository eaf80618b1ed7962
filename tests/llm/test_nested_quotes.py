"""Quotes of depth 2 and more."""

from riskweave.llm import quotes


def test_deeper_quotes_name_an_ancestor(spark):
    rows = [
        (5, 0, "user", "Alpha says"),
        (5, 1, "assistant", "> Alpha says\nBeta"),
        (5, 2, "user", ">> Alpha says\nGamma"),  # nested quotes only
        (5, 3, "user", "> Beta, but edited\n>> Alpha says\nDelta"),
        (5, 4, "user", ">>> Alpha says\n>> Beta\n> Changed\nEpsilon"),  # the nearest ancestor that is found
        (5, 5, "user", "> Beta\n>> Gamma\n>> Gamma\n>> Gamma\nZeta"),  # depth 1 goes first
        (5, 6, "user", ">> never said\nEta"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotes.reply_order(frame).collect()}
    assert [got[t]["reply_to"] for t in range(7)] == [None, 0, 0, 0, 1, 1, None]
    assert [got[t]["thread"] for t in range(7)] == [0, 0, 0, 0, 0, 0, 6]
    assert got[2]["text"] == "Gamma" and got[4]["quote_depth"] == 3

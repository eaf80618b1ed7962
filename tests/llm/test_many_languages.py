"""Every language of the table is learnt."""

import random

import numpy as np
import pytest

from riskweave.llm import langid


@pytest.mark.parametrize("total", [None, 30])
def test_more_languages_than_sixteen(spark, monkeypatch, total):
    r = random.Random(2)
    sound = {f"l{i:02}": [chr(0x400 + 6 * i + k) for k in range(6)] for i in range(20)}
    names = [lang for i, lang in enumerate(sound) for _ in range(20 + 2 * i)]
    rows = [(i, " ".join("".join(r.choice(sound[lang]) for _ in range(6)) for _ in range(30)), lang) for i, lang in enumerate(names)]
    blank = [(5000 + i, "12 ##", "l00") for i in range(200)]  # nothing to learn from
    frame = spark.createDataFrame(rows + blank, "doc_id long, text string, lang string")
    if total:
        monkeypatch.setattr(langid, "SAMPLE", total)  # fewer rows than two a language
    langs, weights = langid.trained(frame)
    assert langs == sorted(sound)
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(frame, "doc_id", "text", langs, weights).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95
    kept = {x["doc_id"] for x in langid.keep_identified(frame).collect()}
    assert len(kept & {i for i, *_ in rows}) > 0.95 * len(rows)

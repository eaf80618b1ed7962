"""The bounded samples that models are fitted on, and what the fits are worth against plain loops."""

import random

import numpy as np
import pytest

from riskweave.llm import langid, quality


def test_a_language_whose_rows_share_one_id_is_learnt(spark):
    rows = [(i, f"text {chr(97 + i)} number {k}", f"l{i}") for i in range(6) for k in range(3_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(frame, "doc_id", "text", "lang", frame["doc_id"] >= 0)
    assert sorted(lang for _, lang in got) == [f"l{i}" for i in range(6)]


def test_a_language_whose_ids_are_in_others_too_is_learnt(spark):
    rows = [(i, f"words {i}", "aa") for i in range(50)] + [(i, f"mots {i}", "zz") for i in range(3)] + [(7, "eins", "mm")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(frame, "doc_id", "text", "lang", frame["doc_id"] >= 0)
    assert {lang for _, lang in got} == {"aa", "mm", "zz"} and len(got) == 50


@pytest.mark.parametrize("text", ["½ ² ③", "12 ٣", "Ⅷ", "_ - !", "", None])
def test_numbers_are_no_letters(spark, text):
    langs, weights = langid.fit([("abc def", "x"), ("½ ² ③ abc", "y")])
    frame = spark.createDataFrame([(1, text), (2, "½ é")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame, "doc_id", "text", langs, weights).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] != "und"


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 5)
    frame = spark.createDataFrame([(i, "a text", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.trained(frame)


def test_language_kernel_against_plain_loops(spark):
    """Presence kernel, landmarks and ridge once more, text by text and n-gram by n-gram."""
    r = random.Random(4)
    sound = {"aa": "abcdefgh", "bb": "abcxyzwv", "cc": "mnopqéüß"}
    make = lambda lang: " ".join("".join(r.choice(sound[lang]) for _ in range(r.randrange(2, 7))) for _ in range(12))
    rows = [(make(lang), lang) for _ in range(30) for lang in sound]

    def grams(text):
        raw = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()]
        padded, out = raw + [32] * 4, set()
        for i in range(len(raw)):
            name = 0
            for k in range(4):
                name = (name + padded[i + k] + 1) * 0x9E3779B1 % 2**32
                name ^= name >> 15
                out.add(name % langid.DIM)
        return out

    def kernel(x, y):
        return len(x & y) / (len(x) * len(y)) ** 0.5

    sets = [grams(t) for t, _ in rows]
    marks = [g for lang in sorted(sound) for g in [s for s, (_, x) in zip(sets, rows) if x == lang][: langid.LANDMARKS // 3]]
    inner = np.array([[kernel(x, y) for y in marks] for x in marks])
    cross = np.array([[kernel(x, y) for y in marks] for x in sets])
    goal = np.array([[x == lang for lang in sorted(sound)] for _, x in rows], dtype=float)
    alpha = np.linalg.solve(cross.T @ cross + langid.RIDGE * len(rows) * (inner + 1e-6 * np.eye(len(marks))), cross.T @ goal)
    langs, weights = langid.fit(rows)
    fresh = [make(lang) for lang in sound for _ in range(10)]
    want = np.array([[kernel(grams(t), m) for m in marks] for t in fresh]) @ alpha
    frame = spark.createDataFrame(list(enumerate(fresh)), "doc_id long, text string")
    for x in langid.identify(frame, "doc_id", "text", langs, weights).collect():
        own = want[x["doc_id"]]
        assert abs(x["score"] - min(1, max(0, own.max()))) < 5e-3
        assert own[langs.index(x["lang_pred"])] > own.max() - 5e-3


def labelled(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frames = [spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")]
    return quality.training_rows(*frames)


def test_a_text_that_does_not_fit_is_left_out_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "FIT_BYTES", 5_000)
    docs = [(i, "w" * 10) for i in range(199)] + [(1000 + i, "x" * 6_000) for i in range(20)]
    got = labelled(spark, tmp_path, docs, [(i, i % 2) for i, _ in docs])
    assert len(got) == 199


def test_labels_without_documents_take_no_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 200)
    docs = [(i, f"text {i}") for i in range(199)]
    assert len(labelled(spark, tmp_path, docs, [(i, i % 2) for i in range(60_000)])) == 199


def test_quality_fit_against_a_plain_loop(monkeypatch):
    """The same steps for one weight after the other."""
    r = random.Random(9)
    rows = [(" ".join(r.choice(["sun", "moon", "sea"] if y else ["buy", "win", "moon"]) for _ in range(8)), y) for y in [0, 1, 1, 0] * 6]
    monkeypatch.setattr(quality, "STEPS", 20)
    weights, slope, offset = quality.fit(rows)
    from riskweave.llm.words import Chunk

    shares = []
    for t, _ in rows:
        chunk = Chunk(0, [t.encode()])
        own = {}
        for k, (places, _) in enumerate(quality.families(chunk, chunk.hashes())):
            for p in places:
                own[k, int(p)] = own.get((k, int(p)), 0) + 1 / len(places)
        shares.append(own)
    test = [i % 4 == 3 for i in range(len(rows))]
    count = {y: sum(1 for (_, x), t in zip(rows, test) if x == y and not t) for y in (0, 1)}
    w, bias, m, v = {}, 0.0, {}, {}
    best, least = None, float("inf")
    score = [0.0] * len(rows)
    for step in range(1, 21):
        error = [0.0 if t else 0.5 / count[y] * (1 / (1 + np.exp(-(s + bias))) - y) for (_, y), t, s in zip(rows, test, score)]
        slopes = {"bias": sum(error)}
        for own, e in zip(shares, error):
            for key, x in own.items():
                slopes[key] = slopes.get(key, 0.0) + x * e
        for key in slopes:
            g = slopes[key] + (quality.DECAY * w.get(key, 0.0) if key != "bias" else 0.0)
            m[key], v[key] = 0.9 * m.get(key, 0.0) + 0.1 * g, 0.99 * v.get(key, 0.0) + 0.01 * g * g
            change = quality.RATE * (m[key] / (1 - 0.9**step)) / ((v[key] / (1 - 0.99**step)) ** 0.5 + 1e-9)
            if key == "bias":
                bias -= 0.1 * change
            else:
                w[key] = w.get(key, 0.0) - change
        score = [sum(w[key] * x for key, x in own.items()) for own in shares]
        if step % quality.CHECK == 0:
            said = [s + bias for s, t in zip(score, test) if t]
            loss = float(np.mean([np.log1p(np.exp(x)) - y * x for x, (_, y) in zip(said, [z for z, t in zip(rows, test) if t])]))
            if loss >= least:
                break
            least, best = loss, (dict(w), list(score))
    # The steps divide by the size of a slope, so where slopes nearly cancel out, single precision shows in a weight.
    score = [sum(weights[key] * x for key, x in own.items()) for own in shares]
    assert np.abs(np.array(score) - best[1]).max() < 0.05 * np.std(best[1])
    p = [1 / (1 + np.exp(-(slope * s + offset))) for s in best[1]]
    assert np.mean([(x >= 0.5) == bool(y) for x, (_, y) in zip(p, rows)]) > 0.9

"""The training-data operators against brute force, on small tables with hard rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import jaccard, langid, licenses, media, mixing, pieces, quality, quotes, sharding, substrings
from riskweave.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, block string"


def corpus():
    """Null, empty and blank texts, a long one, copies, near copies, shared passages, runs; columns with clashing names."""
    r = random.Random(3)
    vocab = [f"w{i}é" for i in range(300)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    passage, base = say(60), say(200)
    texts = [None, "", " \n\t ", "one", "two words", " ".join(base), " ".join(base), "ha " * 40, "HA " * 40, " ".join(say(6000))]
    for i in range(12):  # near copies
        near = list(base)
        near[r.randrange(200)] = f"x{i}"
        texts.append("  ".join(near))
    for i in range(12):  # a passage that many share
        own = say(80)
        at = r.randrange(80)
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [" ".join(base[:13]), " ".join(base[:12]), " ".join(passage[20:40] + passage[20:40]), "\x85a b c\x0bd"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(d, t, "en" if d % 2 else None, f"s{min(d % 7, 2)}" if d % 5 else None, 1, "k", "b") for d, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_substrings(docs, empty):
    rows = {d: words(t) for d, t, *_ in corpus()}
    first: dict = {}
    for d in sorted(rows):
        for i in range(len(rows[d]) - 12):
            first.setdefault(tuple(rows[d][i : i + 13]), d)
    want = {}
    for d, ws in rows.items():
        gone = {i + k for i in range(len(ws) - 12) if first[tuple(ws[i : i + 13])] < d for k in range(13)}
        want[d] = (len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup_substrings(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert substrings.dedup_substrings(empty).count() == 0
    lone = docs.where("doc_id < 0").union(docs.sparkSession.createDataFrame([(None, "a " * 30, None, None, 1, "", ""), (None, "a " * 30, None, None, 1, "", "")], SCHEMA))
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(lone).collect()] == [(None, 30, 0)] * 2
    assert substrings.without_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed):
    """Many runs and repeats: two words only."""
    r = random.Random(seed)
    texts = ["".join(r.choice(["a ", "a ", "b "]) for _ in range(r.randrange(10, 120))) for _ in range(40)]
    first: dict = {}
    for d, t in enumerate(texts):
        ws = t.split()
        for i in range(len(ws) - 12):
            first.setdefault(tuple(ws[i : i + 13]), d)
    got = {x["doc_id"]: x["n_removed"] for x in substrings.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        ws = t.split()
        assert got[d] == len({i + k for i in range(len(ws) - 12) if first[tuple(ws[i : i + 13])] < d for k in range(13)})


def shingles(text):
    ws = words("" if text is None else re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard(docs, empty, monkeypatch):
    want = brute_components([(d, t) for d, t, *_ in corpus()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want) - 10
    assert jaccard.similar_components(empty).count() == 0
    monkeypatch.setattr(jaccard, "CHUNK", 400)  # every block makes several trees
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs).collect()}
    assert got == want
    assert jaccard.one_of_each(docs).count() == len({c for _, c in want.values()})


def test_jaccard_chains(spark, monkeypatch):
    """A chain of texts of which only neighbours link, over the whole range of sizes, and one beside it."""
    ws = [f"v{i}" for i in range(90)]
    rows = [(i, " ".join(ws[i : i + 60])) for i in range(0, 30, 2)] + [(99, " ".join(ws[:20])), (98, None), (97, " ".join(ws[:20]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "CHUNK", 120)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(frame).collect()}
    assert got == brute_components(rows)


def test_tree_join_finds_all_links():
    r = np.random.default_rng(5)
    pool = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(r.choice(pool[k * 60 : k * 60 + 70], 50)) for k in range(5) for _ in range(40)]
    links = jaccard.tree_join(sets, np.arange(len(sets)), 60)
    up = list(range(len(sets)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in links:
        up[find(a)] = find(b)
    ours = [find(i) for i in range(len(sets))]
    up = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both):
            up[find(a)] = find(b)
    theirs = [find(i) for i in range(len(sets))]
    pairs = lambda x: {(a, b) for a, b in itertools.combinations(range(len(x)), 2) if x[a] == x[b]}
    assert pairs(ours) == pairs(theirs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pieces_round_trip_and_order(docs, empty):
    rows = pieces.encode_top_k(docs, "doc_id", "text", k=3, keep=("key",))
    got = {r["doc_id"]: r for r in rows.collect()}
    for d, t, *_ in corpus():
        r = got[d]
        if t is None:
            assert r["samples"] is None
            continue
        assert r["round_trip"] and r["text"] == t and r["key"] == "k"
        ids = [tuple(s["ids"]) for s in r["samples"]]
        assert len(set(ids)) == len(ids) >= 1
        noisy = [s["perturbed"] for s in r["samples"]]
        assert noisy == sorted(noisy, reverse=True) and all(s["log_inclusion"] <= 0 for s in r["samples"])
    again = {r["doc_id"]: r["samples"] for r in pieces.encode_top_k(docs.repartition(1), "doc_id", "text", k=3).collect()}
    assert again == {d: r["samples"] for d, r in got.items()}
    assert pieces.encode_top_k(empty, "doc_id", "text").count() == 0
    read = pieces.decode_samples(rows, ["doc_id", "text"])
    assert read.where("text IS NOT NULL AND exists(texts, t -> t != text)").count() == 0


def test_pieces_are_gumbel_top_k():
    """Frequencies of the first sample and inclusion of three, against listing all segmentations."""
    v, text, n = pieces.load(), "né a", 6000
    index = {p: i for i, p in enumerate(v.pieces) if not v.is_byte[i] and i > 2}
    marked, found = pieces.SPACE + text.replace(" ", pieces.SPACE), []

    def go(i, ids, score):
        if i == len(marked):
            found.append((tuple(ids), score))
        for size in range(1, 17):
            if i + size <= len(marked) and marked[i : i + size] in index:
                j = index[marked[i : i + size]]
                go(i + size, [*ids, j], score + v.scores[j])

    go(0, [], 0.0)
    p = np.exp([s for _, s in found])
    chance = dict(zip([s for s, _ in found], p / p.sum(), strict=True))
    lattice = pieces.Lattice(v)
    units = lattice.numbered([pieces._units(v, text)])[0]
    seeds = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    paths, after = pieces.top_k(lattice, [units] * n, seeds, 3)
    drawn, total = [[] for _ in range(n)], 0.0
    for own in paths:
        for row, a, m, log_p in zip(own.texts, own.begins, own.sizes, own.log_p, strict=True):
            ids = tuple(pieces.ids_of(v, lattice, own.edges[a : a + m])[0].tolist())
            assert abs(math.exp(log_p) - chance[ids]) < 1e-9
            total += chance[ids] / -math.expm1(-chance[ids] * after[row])
            drawn[row].append(ids)
    assert abs(total / n - 1) < 0.02  # each sample weighted by its inclusion probability
    assert all(len(set(x)) == len(x) == 3 for x in drawn)
    first = Counter(x[0] for x in drawn)
    assert all(abs(first[ids] / n - q) < 0.02 for ids, q in chance.items())
    pairs = Counter(tuple(x[:2]) for x in drawn)  # the joint order of two: p(a) p(b) / (1 - p(a))
    assert all(abs(pairs[one, two] / n - p1 * p2 / (1 - p1)) < 0.02 for one, p1 in chance.items() for two, p2 in chance.items() if one != two)


def test_pieces_do_not_depend_on_the_chunk():
    """Units of earlier chunks, kept or trimmed, change nothing."""
    v, texts = pieces.load(), ["one two three", "zwei drei", "xq one 日本 🙂 two", ""]
    seeds = np.arange(4, dtype=np.uint64) + np.uint64(5)

    def told(lattice, some):
        rows = lattice.numbered([pieces._units(v, texts[i]) for i in some])
        paths, after = pieces.top_k(lattice, rows, seeds[some], 2)
        out = {}
        for own in paths:
            for row, a, m in zip(own.texts, own.begins, own.sizes, strict=True):
                out.setdefault(some[row], []).append(pieces.ids_of(v, lattice, own.edges[a : a + m])[0].tolist())
        return out, after.tolist()

    alone = {}
    for i in range(4):
        alone |= told(pieces.Lattice(v), [i])[0]
    for most in (1, 40, 1 << 20):
        lattice, got = pieces.Lattice(v), {}
        for some in ([2, 0], [1], [3], [0, 1, 2]):
            got |= told(lattice, some)[0]
            lattice.trim(most)
        assert got == alone


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs.union(docs), "doc_id", "text", 24).collect()
    assert len(rows) == 2 * len(corpus())
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    texts = {d: t for d, t, *_ in corpus()}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8 for r in rows)
    assert sharding.assign_shards(empty, "doc_id", "text", 24).count() == 0


def test_jump_hash_is_even_and_consistent(spark):
    n = 20000
    frame = spark.range(n).select("id", *[sharding.jump_hash(F.col("id"), k).alias(f"s{k}") for k in (1, 24, 25, 60, 61)])
    rows = frame.collect()
    assert {r["s1"] for r in rows} == {0}
    for k in (24, 60):
        counts = np.bincount([r[f"s{k}"] for r in rows], minlength=k)
        assert len(counts) == k and abs(counts - n / k).max() < 6 * math.sqrt(n / k)
        moved = [r for r in rows if r[f"s{k}"] != r[f"s{k + 1}"]]
        assert all(r[f"s{k + 1}"] == k for r in moved) and abs(len(moved) - n / (k + 1)) < 6 * math.sqrt(n / k)


def test_language(spark, docs, empty):
    r = random.Random(1)
    sound = {"aa": "abcde", "bb": "vwxyz", "cc": "éüñçö"}
    rows = [(i, " ".join("".join(r.choice(sound[lang]) for _ in range(6)) for _ in range(30)), lang) for i in range(300) for lang in [r.choice(list(sound))]]
    frame = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 ## \n", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    langs, weights = langid.trained(frame)
    got = {x["doc_id"]: x for x in langid.identify(frame.withColumn("held_out", langid.held_out(F.col("doc_id"))), "doc_id", "text", langs, weights, keep=("held_out",)).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902)) and all(0 <= x["score"] <= 1 for x in got.values())
    langs, weights = langid.trained(empty)
    assert langs == [] and langid.identify(docs, "doc_id", "text", langs, weights).where("lang_pred != 'und'").count() == 0
    assert langid.keep_identified(frame).columns == frame.columns and langid.keep_identified(frame).count() >= 295


def brute_counts(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    again = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def test_quality(spark, docs, empty):
    extra = spark.createDataFrame([(500, "a b\na b\n \n \nc # | é", None, None, 1, "", ""), (501, "x y z x y z x", None, None, 1, "", "")], SCHEMA)
    rows = docs.union(extra)
    want = {r["doc_id"]: brute_counts(r["text"]) for r in rows.collect()}
    got = {r["doc_id"]: tuple(r[c] for c in quality.COLUMNS) for r in quality.rate(rows, "doc_id", "text", None).collect()}
    assert got == want
    r = random.Random(4)
    good = [" ".join(r.choice(["sun", "moon", "star"]) for _ in range(60)) for _ in range(200)]
    bad = [" ".join(r.choice(["$$$", "buy", "now!!"]) for _ in range(60)) for _ in range(200)]
    model = quality.fit([x for pair in zip([(t, 1) for t in good[:150]], [(t, 0) for t in bad[:150]], strict=True) for x in pair])
    frame = spark.createDataFrame(list(enumerate(good[150:] + bad[150:])), "doc_id long, text string")
    p = {x["doc_id"]: x["quality_p"] for x in quality.rate(frame, "doc_id", "text", model).collect()}
    assert np.mean([(p[i] >= 0.5) == (i < 50) for i in p]) > 0.95
    assert quality.fit([("a", 1)]) is None and quality.rate(empty, "doc_id", "text", model).count() == 0


def test_media_digests(docs, empty):
    rows = {r["doc_id"]: r for r in media.decode_media(media.store_payload(docs, "doc_id", "text"), ["doc_id", "n_bytes"]).collect()}
    for d, t, *_ in corpus():
        data = (t or "").encode()
        payload = data + b" " * (192 - len(data) % 192 if len(data) % 192 or not data else 0)
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and len(payload) % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert bytes(r["media"]).endswith(payload) and len(r["pcm"]) == 2 * int(r["feature"].split(";")[1])
    assert media.decode_media(media.store_payload(empty, "doc_id", "text"), ["doc_id"]).count() == 0
    assert len({r["codec"] for r in rows.values()}) == 3


def test_query_of_media_digests_the_pcm(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pcm = {r["doc_id"]: bytes(r["pcm"]) for r in media.decode_media(media.store_payload(docs, "doc_id", "text"), ["doc_id"]).collect()}
    for r in media.op9_media(spark, str(tmp_path)).collect():
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (len(pcm[r["doc_id"]]), hashlib.sha256(pcm[r["doc_id"]]).hexdigest())


def test_codecs():
    mu, a = media.TABLES["mulaw"], media.TABLES["alaw"]
    assert (int(mu[0xFF]), int(mu[0x00]), int(mu[0x80])) == (0, -32124, 32124)
    assert (int(a[0xD5]), int(a[0x55]), int(a[0xAA]), int(a[0x2A])) == (8, -8, 32256, -32256)
    r = np.random.default_rng(0)
    blocks = r.integers(0, 256, (7, 192)).astype(np.uint8)
    for block, got in zip(blocks, media.decode_ima(blocks), strict=True):
        value = int.from_bytes(bytes(block[:2]), "little", signed=True)
        index, want = min(int(block[2]), 88), [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.IMA_STEPS[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(media.IMA_INDEX[code])))
                want.append(value)
        assert got.tolist() == want
    assert media.resampled(np.array([100, 200, 300, 400], dtype=np.int16)).tolist()[2:5] == [200, 250, 300]


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 5), None, "big" if i % 10 else f"s{i // 10 % 2}", 0, "", "") for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mixture(frame)
    got = plan.collect()
    tokens = {}
    for r in got:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n"]
    own = {}
    for _, t, _, s, *_ in rows:
        own[s] = own.get(s, 0) + len(words(t))
    assert {r["id"] for r in got} == set(range(1000)) and tokens["big"] == own["big"]
    assert all(abs(tokens[s] / own[s] - 2) < 0.05 for s in ("s0", "s1"))  # the limit of repeats
    for block in {r["block"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["block"] == block)
        assert slots == list(range(1, len(slots) + 1))
    weights = mixing.source_weights(mixing.unit_tokens(frame), max_repeats=None, target_entropy=0.9).collect()
    entropy = -sum(r["weight"] * math.log(r["weight"]) for r in weights) / math.log(3)
    assert abs(entropy - 0.9) < 1e-4
    assert mixing.mixture(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == len(corpus())


def test_licenses(spark, docs, empty):
    pad = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod"
    rows = [(i, f"{pad}\n{t}\n{pad}") for i, t in enumerate(licenses.TEMPLATES.values())]
    gpl = licenses.TEMPLATES["gpl-3"]
    rows += [(50, gpl.upper()), (51, "Licensed under the"), (52, None), (53, ""), (54, f"{gpl} {pad} Released under the MIT License."), (55, licenses.TEMPLATES["apache-2.0-notice"].replace("language", "x").replace("writing", "paper"))]
    found = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    got = {}
    for r in found:
        got.setdefault(r["doc"], set()).add(r["license"])
    for i, name in enumerate(licenses.TEMPLATES):
        assert name in got[i]
    assert got[50] == {"gpl-3"} and got[54] == {"gpl-3", "mit"} and "apache-2.0-notice" in got[55] and not {51, 52, 53} & set(got)
    assert licenses.license_matches(empty, "doc_id", "text").count() == 0
    assert licenses.license_matches(docs, "doc_id", "text").count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"),
        (1, 1, "assistant", "> hello   there.\n> How are you?\nFine."),
        (1, 2, "user", "Something else"),
        (1, 3, "user", ">> Hello there.\n> Fine.\nGood"),
        (1, 4, "user", "> never said\nok"),
        (1, 5, "user", ">Something else\n\nyes"),
        (2, 1, "user", "> Fine.\nother conversation"),
        (3, None, "user", "x"), (None, 0, "user", "> y"), (3, 0, None, None), (3, 1, "user", ""), (3, 1, "user", ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parent", F.lit(1)).withColumn("root", F.lit(2))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_order(frame).collect()}
    assert [got[1, t]["reply_to"] for t in range(6)] == [None, 0, None, 1, None, 2]
    assert [got[1, t]["thread"] for t in range(6)] == [0, 0, 2, 0, 4, 2] and got[1, 3]["depth"] == 2
    assert [t for _, t in sorted((got[1, t]["position"], t) for t in range(6))] == [0, 1, 3, 2, 5, 4]
    assert got[1, 1]["text"] == "Fine." and got[1, 3]["quote_depth"] == 2 and got[2, 1]["reply_to"] is None
    assert quotes.reply_order(frame).count() == len(rows) and quotes.reply_order(frame.where("false")).count() == 0

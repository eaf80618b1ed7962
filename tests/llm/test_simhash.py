"""Fingerprints and their links against comparisons of all pairs."""

import random

import numpy as np
import pytest
import xxhash

from riskweave.llm import simhash
from riskweave.llm.graph import connected_components


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, radius):
    codes = np.array(sorted(codes), dtype=np.uint64)
    label = list(range(len(codes)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1 :]) <= radius) + i + 1:
            a, b = top(i), top(int(j))
            label[max(a, b)] = min(a, b)
    return {int(c): top(k) for k, c in enumerate(codes)}


def clustered(rng, groups=25, each=40):
    out = set()
    for _ in range(groups):
        code = rng.getrandbits(64)
        for _ in range(each):
            other = code
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                other ^= 1 << b
            out.add(other)
            code = rng.choice([code, other])
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_trees_find_every_link(radius):
    rng = random.Random(radius)
    codes = np.array(sorted(clustered(rng, 6, 60)), dtype=np.uint64)
    roots = np.zeros(len(codes), dtype=np.int64)
    child = simhash.trees(codes, roots)
    got = {(int(a), int(b)) for x, y in simhash.near(codes, roots, child, radius) for a, b in zip(x, y)}
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= radius)) if i > j} and len(got) > 50
    for node in range(len(codes)):  # a child lies at its edge's distance from its parent
        for d in np.flatnonzero(child[node] >= 0):
            assert np.bitwise_count(codes[node] ^ codes[child[node, d]]) == d


@pytest.mark.parametrize(("radius", "most", "small"), [(2, 8192, 16), (2, 8, 16), (2, 4, 2), (1, 4, 16), (3, 16, 16)])
def test_shards_lose_no_link(spark, monkeypatch, radius, most, small):
    monkeypatch.setattr(simhash, "MOST", most)  # small shards, so that large ones are split
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "RUN", 100)
    codes = clustered(random.Random(most + radius))
    frame = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    members = {r["doc"] % 2**64: r["component"] % 2**64 for r in connected_components(simhash.links(frame, radius)).collect()}
    want = components(codes, radius)
    groups = {}
    for c in codes:
        groups.setdefault(members.get(c, c), set()).add(want[c])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(want.values())) < len(codes)


def test_documents(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta omega SIGMA é ß".split()) + str(rng.randrange(9))
    rows = []
    for k in range(60):
        body = [word() for _ in range(rng.choice([1, 2, 3, 60, 200]))]
        rows.append((10 + 3 * k, " ".join(body)))
        rows.append((1000 + k, "\t".join(body).upper()))  # same words, other case and spaces
        if len(body) > 50:
            rows.append((2000 + k, " ".join([*body, word()])))
    rows += [(5, None), (6, ""), (7, " \n"), (8, "x"), (3, "x"), (3, "x"), (None, "x"), (None, "only here"), (9, "long words " * 40_000)]
    frame = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(frame, "doc_id", "text").collect()
    assert len(got) == len(rows)
    prints = {t: brute_fingerprint(t) for _, t in rows}
    want = components(set(prints.values()), 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[want[prints[t]]] = min(least.get(want[prints[t]], i), i)
    expected = sorted((i or -1, f"{prints[t]:016x}", least.get(want[prints[t]], -1)) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"] or -1) for r in got) == expected
    assert prints[None] == prints[" \n"] == 0 and len(set(want.values())) < len(prints)
    assert simhash.near_duplicates(frame.where("false"), "doc_id", "text").count() == 0

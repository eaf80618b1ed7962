"""The prefix trie against a plain one; places in large groups."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskweave.llm import numbering, prefixes, quotes
from riskweave.llm.common import written
from riskweave.llm.numbering import numbered

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """One row a node: the contract, conversation by conversation."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    seq = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        seq[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        cost = (len(cs) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not children[p]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), children[p], leaves[p], saved[p], digest([c for c in cs if seq[c] == p])) for p, cs in members.items()
    )


def found(spark, tmp_path, rows, schema=SCHEMA, name="c"):
    folder = tmp_path / name
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder / "conversations.parquet"))
    out = prefixes.op13_prefixes(spark, str(folder)).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out)


@pytest.mark.parametrize("cell", [2, 4096])
def test_against_a_plain_trie(spark, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(prefixes, "CELL", cell)
    monkeypatch.setattr(prefixes, "IDS", 7)
    r = random.Random(cell)
    rows = []
    for c in [*range(3, 90), 1000, 1001, 5000, 10**12]:  # conversations without a base, and with large numbers
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "a b", "", None, "c\td é"])))
    rows += [(20, None, "user", "first of all"), (None, 1, "user", "nowhere")]
    same = [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(4)]  # copies
    longer = [(300, t, "user", f"long {t % 3} x") for t in range(60)] + [(301, t, "user", f"long {t % 3} x") for t in range(40)]
    assert found(spark, tmp_path, rows + same + longer) == brute(rows + same + longer)


def test_edges(spark, tmp_path):
    assert found(spark, tmp_path, [], name="empty") == []
    one = [(20, 0, None, None)]
    assert found(spark, tmp_path, one, name="one") == brute(one)
    tied = [(40, 1, "user", "x y"), (40, 1, "user", "x y"), (40, 1, "user", "x y"), (40, None, "a", "b")]  # repeated rows
    assert found(spark, tmp_path, tied, name="tied") == brute(tied)
    long = [(60, 0, "user", "w " * 300_000), (61, 0, "user", "w " * 300_000 + "v")]
    assert found(spark, tmp_path, long, name="long") == brute(long)
    clash = [(*x, 1, "z", 2.0) for x in one + long]
    assert found(spark, tmp_path, clash, SCHEMA + ", depth int, a string, _place double", name="clash") == brute(one + long)


def test_members_are_real_outputs(spark):
    rows = [(c, t, "user", f"t{t}") for c in (1, 2, 3) for t in range(c)]
    turns = numbered(prefixes.named_turns(spark.createDataFrame(rows, SCHEMA)), ["conv_id"], ["turn", "a", "b"], "at").withColumn("depth", F.col("at") + 1)
    nodes, ends = prefixes.trie(turns, turns.select("conv_id").distinct())
    assert {(r["conv_id"], r["depth"]): r["n_convs"] for r in nodes.collect()} == {(1, 0): 3, (1, 1): 3, (2, 2): 2, (3, 3): 1}
    assert sorted((r["depth"], r["ids"]) for r in prefixes.end_lists(ends).collect()) == [(1, "1"), (2, "2"), (3, "3")]


@pytest.mark.parametrize("rows", [[(1, None, k % 5) for k in range(20_000)], [(1, k, 0) for k in range(20_000)] + [(2, 1, 1)], [(k % 9, 3, 3) for k in range(2_000)], []])
def test_places_in_large_groups(spark, rows):
    frame = spark.createDataFrame(rows, "g long, o long, v long")
    out = numbered(frame.repartition(6), ["g"], ["o", "v"], "place")
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["g"]].append((r["place"], (r["o"] is not None, r["o"] or 0, r["v"])))
    for x in got.values():
        assert [p for p, _ in sorted(x)] == list(range(len(x))) and [v for _, v in sorted(x)] == sorted(v for _, v in x)
    assert sum(map(len, got.values())) == len(rows)


def test_large_groups_are_many_tasks_work(spark, monkeypatch):
    """No partition of the numbering holds most of one group, even of rows that are all alike."""
    tables = []
    monkeypatch.setattr(numbering, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        frame = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("g"), F.lit(None).cast("long").alias("o"))
        assert numbered(frame, ["g"], ["o"], "place").agg(F.max("place")).first()[0] == 39_999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in tables[0].groupBy("_range").count().collect()]
    assert sum(parts) == 40_000 and max(parts) < 0.6 * 40_000


def test_null_and_repeated_turns_in_number(spark):
    rows = [(5, None, "user", f"message {k % 50}") for k in range(3_000)] + [(5, 7, "user", "again")] * 2_000 + [(5, 8, "user", "> again\nyes")]
    got = quotes.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert {(r["reply_to"], r["thread"], r["position"] >= 5_000) for r in got if r["turn"] == 8} == {(7, 7, True)}

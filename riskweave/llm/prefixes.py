"""A trie of conversation prefixes by whole-sequence collapse.

1. Every turn becomes two 64-bit names of its role and text and a count of words; texts go no further. Turns get their
   places in their conversation (``numbering.py``), and conversations are rebuilt: their first turns may come from another one.
2. A prefix is named by its depth and the exclusive or of its turns' names, each mixed with its depth, in two lanes: equal
   sequences have equal names, others differ but for a chance of 2**-128 a pair. Unlike a chain of hashes, that can be
   summed in parts, so a very long conversation is many tasks' work.
3. Identical conversations are grouped into one weighted sequence, named by its smallest conversation; from here on only
   distinct sequences count. Their members are kept beside as lists of ends.
4. Sequences that are a proper prefix of another go by an anti-join: those that are left are the leaves.
5. Weighted prefixes are aggregated to nodes. A node's leaves are the leaf sequences that pass it. Its saved tokens are a sum over
   its subtree, but need no walk: the words of all members' turns from here on (weight times suffix of each sequence), less
   those of each distinct node once. A node is counted in the sequence of its smallest conversation, so a sequence counts
   its own turns from some depth on.
6. Digests of ends: ids of a node are joined within ranges of IDS, and the ranges hashed in order, one after another.

Nulls: a null conversation's rows are left out; a null turn comes first; a null role or text is empty. Turns that tie are in
order of their names, which depend on role and text alone. Repeated rows are turns of their own. A long text only adds to the
first scan. An empty table gives an empty result. Columns other than the four that are named are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import count_words, table, written
from riskweave.llm.numbering import numbered

CELL = 4096  # depths that are summed in one window
IDS = 4096  # conversation numbers in a range
KEY = ["depth", "a", "b"]


def named_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, a, b (names of role and text) and words of (conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    names = {"a": F.xxhash64(role, text), "b": F.xxhash64(text, role)}
    return messages.where("conv_id IS NOT NULL").select("conv_id", "turn", *[x.alias(c) for c, x in names.items()], count_words(text).alias("words"))


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, a, b, words) of the rebuilt conversations, and every conv_id.

    ``turns``: conv_id, at (0, 1, ...), a, b, words. A conversation begins with the first ``head`` turns (``most`` at most) of
    conversation ``base`` (all if it has fewer) and goes on with its own turns after its first ``head``."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", base.alias("base"), head.alias("head"))
    have = sizes.select(F.col("conv_id").alias("_of"), F.col("n").alias("_n"))
    convs = convs.join(have, F.col("base") == F.col("_of"), "left")
    convs = written(convs.select("conv_id", "base", "head", F.least("head", F.coalesce("_n", F.lit(0))).alias("taken")), "conversations")
    firsts = turns.where(F.col("at") < most).select(F.col("conv_id").alias("_of"), "at", "a", "b", "words")
    firsts = convs.where("taken > 0").join(firsts, (F.col("base") == F.col("_of")) & (F.col("at") < F.col("taken")))
    firsts = firsts.select("conv_id", (F.col("at") + 1).alias("depth"), "a", "b", "words")
    own = turns.join(convs.select(F.col("conv_id").alias("_conv"), "head", "taken"), (F.col("conv_id") == F.col("_conv")) & (F.col("at") >= F.col("head")))
    own = own.select("conv_id", (F.col("taken") + F.col("at") - F.col("head") + 1).alias("depth"), "a", "b", "words")
    return firsts.union(own), convs.select("conv_id")


def _steps(turns: DataFrame) -> DataFrame:
    """Each turn's share in the names of the prefixes that hold it."""
    return turns.select("conv_id", F.col("depth").cast("long").alias("depth"), F.xxhash64("depth", "a", "b").alias("a"), F.xxhash64("b", "depth", "a").alias("b"), "words")


def sequences(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, words of every conversation's whole sequence; without turns, those of the root."""
    whole = steps.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("words").alias("words"))
    whole = whole.withColumnRenamed("conv_id", "_conv")
    joined = convs.join(whole, F.col("conv_id") == F.col("_conv"), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*KEY, "words")])


def prefixes(steps: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows seq, depth, a, b (name of the prefix), up_a, up_b (of its parent), words (of its last turn), suffix (words from that
    turn on), weight and length, for every prefix of each distinct sequence (seq, depth, a, b, words, weight), the root included."""
    ends = distinct.select("seq", F.col("depth").alias("length"), F.col("words").alias("total"), "weight")
    rows = steps.join(ends, F.col("conv_id") == F.col("seq")).withColumn("_cell", F.floor((F.col("depth") - 1) / CELL))
    sums = [F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("words").alias("words")]
    cells = rows.where(F.col("length") > CELL).groupBy("seq", "_cell").agg(*sums)
    earlier = Window.partitionBy("seq").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(
        F.col("seq").alias("_seq"), F.col("_cell").alias("_of"), F.bit_xor("a").over(earlier).alias("_a"), F.bit_xor("b").over(earlier).alias("_b"), F.sum("words").over(earlier).alias("_words")
    ).where("_a IS NOT NULL")
    so_far = Window.partitionBy("seq", "_cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(
        "seq", "_cell", "depth", "length", "total", "weight", "words", F.col("a").alias("own_a"), F.col("b").alias("own_b"),
        F.bit_xor("a").over(so_far).alias("in_a"), F.bit_xor("b").over(so_far).alias("in_b"), F.sum("words").over(so_far).alias("in_words"),
    )
    run = run.join(before, (F.col("seq") == F.col("_seq")) & (F.col("_cell") == F.col("_of")), "left")
    zero = F.lit(0).cast("long")
    a, b = (F.col(f"in_{c}").bitwiseXOR(F.coalesce(f"_{c}", zero)) for c in "ab")
    suffix = F.col("total") - F.coalesce("_words", zero) - F.col("in_words") + F.col("words")
    run = run.select("seq", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("own_a")).alias("up_a"), b.bitwiseXOR(F.col("own_b")).alias("up_b"), "words", suffix.alias("suffix"), "weight", "length")
    none = F.lit(None).cast("long")
    top = distinct.select("seq", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), zero.alias("words"), F.col("words").alias("suffix"), "weight", F.col("depth").alias("length"))
    return run.union(top)


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the ends: (conv_id, depth, a, b, words), each conversation with its last node.

    ``turns``: conv_id, depth (1, 2, ...), a, b, words, of some of ``convs`` (conv_id). Nodes: depth, a, b (their name), conv_id,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens."""
    steps = written(_steps(turns), "turns")
    ends = written(sequences(steps, convs), "ends")
    distinct = written(ends.groupBy(*KEY).agg(F.min("conv_id").alias("seq"), F.min("words").alias("words"), F.count(F.lit(1)).alias("weight")), "sequences")
    rows = written(prefixes(steps, distinct), "prefixes")
    proper = rows.where("depth < length").select(*KEY).distinct()
    leaves = distinct.join(proper, KEY, "left_anti").select(F.col("seq").alias("_leaf"))

    nodes = rows.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min_by("suffix", "seq").alias("suffix"),
    )
    nodes = written(nodes, "nodes")
    owners = nodes.where("depth > 0").groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.min_by("suffix", "depth").alias("own_words"))
    about = distinct.select("seq").join(leaves, F.col("seq") == F.col("_leaf"), "left").join(owners, F.col("seq") == F.col("conv_id"), "left")
    about = about.select(F.col("seq").alias("_of"), F.col("_leaf").isNotNull().cast("long").alias("leaf"), "own_from", "own_words")
    own = F.when(F.col("own_from").isNull(), 0).when(F.col("depth") <= F.col("own_from"), F.col("own_words")).otherwise(F.col("suffix"))
    below = rows.join(about, F.col("seq") == F.col("_of")).groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("suffix") - own).alias("saved_tokens"))

    up = [(F.col("depth") - 1).alias("_depth"), F.col("up_a").alias("_a"), F.col("up_b").alias("_b")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("depth").alias("_d"), F.col("a").alias("_pa"), F.col("b").alias("_pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, KEY)
    out = out.join(children, (F.col("depth") == F.col("_depth")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    out = out.join(parents, (F.col("depth") - 1 == F.col("_d")) & (F.col("up_a") == F.col("_pa")) & (F.col("up_b") == F.col("_pb")), "left")
    return out.select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens"), ends


def end_lists(ends: DataFrame) -> DataFrame:
    """depth, a, b, range, ids: the conversations that end at a node, ascending and joined by commas, in pieces of one range of
    IDS numbers each."""
    ranges = ends.groupBy(*KEY, F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    return ranges.select(*KEY, "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of every node where conversations end. Only one piece of a list is held at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if key == held:
                    state.update(b",")
                else:
                    if held:
                        done.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=[*KEY, "ends_sha256"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, state.hexdigest())], names=[*KEY, "ends_sha256"])

    dealt = end_lists(ends).repartition(*KEY).sortWithinPartitions(*KEY, "range")
    return dealt.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of ``conversations``, each rebuilt with the first crc32(conv_id) % 4 turns of conversation conv_id - conv_id % 20."""
    turns = numbered(named_turns(table(spark, sf_dir, "conversations")), ["conv_id"], ["turn", "a", "b"], "at")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    nodes, ends = trie(*rebuilt(written(turns, "numbered"), F.col("conv_id") - F.col("conv_id") % 20, head, 3))
    found = end_digests(ends).toDF("_depth", "_a", "_b", "ends_sha256")
    joined = nodes.join(found, (F.col("depth") == F.col("_depth")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


ORACLE = r"""
WITH RECURSIVE convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x) & 15, ascii(x) >> 4]))),
           lambda c, nibble: xor(c >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
             3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108])[1 + xor(c & 15, nibble)])
         )) % 4 AS head
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), kept AS (
  SELECT c.conv_id, t.place AS place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.head
  UNION ALL
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.head
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, role, text,
         length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM kept
), lengths AS (
  SELECT conv_id, coalesce(max(depth), 0) AS length FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY ALL
), names AS (
  SELECT conv_id, 0 AS depth, sha256('') AS name, NULL::VARCHAR AS parent, 0::BIGINT AS words FROM convs
  UNION ALL
  SELECT n.conv_id, r.depth, sha256(n.name || length(r.role) || ':' || r.role || r.text), n.name, r.words
  FROM names n JOIN rebuilt r ON r.conv_id = n.conv_id AND r.depth = n.depth + 1
), nodes AS (
  SELECT name, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM names JOIN lengths USING (conv_id) GROUP BY name
), above AS (
  SELECT name AS top, name FROM nodes
  UNION ALL
  SELECT p.parent, a.name FROM above a JOIN nodes p ON p.name = a.top WHERE p.parent IS NOT NULL
), children AS (
  SELECT parent AS name, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT a.top AS name, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (c.name IS NULL) AS n_leaves
  FROM above a JOIN nodes n ON n.name = a.name LEFT JOIN children c ON c.name = n.name GROUP BY a.top
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.name = n.parent LEFT JOIN children c ON c.name = n.name JOIN subtrees s ON s.name = n.name
"""

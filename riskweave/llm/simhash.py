"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees.

1. Fingerprints. A text's shingles (repeats included) are hashed; a bit is set if it is set in over half of the hashes.
   Documents are grouped by fingerprint, so exact copies are one from here on.
2. Shards. With 64 bits in radius + 2 blocks, two fingerprints that differ in ``radius`` bits or fewer agree in two whole
   blocks at least. Each pair of blocks so makes a shard of the fingerprints that agree in it, and every link lies within a
   shard. A shard of more than MOST fingerprints is split by the same rule over the bits that are still free, until SMALL are
   left: a shard then holds 2**SMALL fingerprints at most, whatever the input.
3. Trees. A task builds the BK-trees of its shards, level by level and many at once: a node's children are keyed by their
   Hamming distance to it. Each fingerprint searches its shard's tree, following only edges within ``radius`` of its distance to
   the node. A tree travels to the task of its shard instead of being broadcast: trees of all documents have no size bound.
4. Links within a shard become stars; the stars of all shards are joined to components (``graph.py``). A fingerprint has one
   edge a shard at most, so edges grow with the input and not with a group's square.

Nulls: a null text has no words and fingerprint zero, which links like any other; null ids are the smallest id of no
component. Rows that repeat an id or a text share a fingerprint. A text of fewer words than a shingle is one shingle. A
long text is hashed whole, SLICE shingles at a time. An empty table gives an empty result. Columns other than the id and
the text are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskweave.llm.common import bounded_batches, table, written
from riskweave.llm.graph import connected_components
from riskweave.llm.words import starts

SEED = 42
SLICE = 1 << 14
MOST, SMALL = 8192, 16
RUN = 1 << 16  # fingerprints whose trees are built together
VISITS = 1 << 22  # pairs of a fingerprint and a node that are held at once, at most


def simhash(text: bytes, n: int = 3) -> int:
    """The unsigned fingerprint of a text's lower-cased n-word shingles; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - n + 1)]
    ends = ends[n - 1 :] if len(words) >= n else ends[-1:]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), SLICE):
        spans = zip(begins[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """key and fp (the fingerprint's 64 bits as a long) for every row."""
    bounded_batches(docs)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x.as_py() or b"", n) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("fp", LongType())])
    return rows.mapInArrow(read, schema).withColumnRenamed("key", key)


def masks_within(free: int, radius: int) -> list[int]:
    """The pairs of blocks that the free bits make, as masks."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = [sum(1 << b for b in part) for part in np.array_split(np.array(bits, dtype=object), radius + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(codes: DataFrame, radius: int) -> Iterator[DataFrame]:
    """Frames of mask, part and fp of distinct ``codes`` (fp), no shard larger than it may be."""
    rows, masks = codes.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    while True:
        finer = {m: [m | x for x in masks_within(~m & (1 << 64) - 1, radius)] for m in masks}
        by_mask = F.create_map(*[x for m, below in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)) for b in below]))])
        rows = rows.select("fp", F.explode(by_mask[F.col("mask")]).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({b for below in finer.values() for b in below})
        if all(64 - m.bit_count() <= SMALL for m in masks):
            yield rows
            return
        large = written(rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("mask", "part"), "large-shards")
        if large.isEmpty():
            yield rows
            return
        yield rows.join(large, ["mask", "part"], "left_anti")
        rows = rows.join(large, ["mask", "part"], "left_semi").select("fp", "mask")


def trees(codes: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """child[node, d]: the child at distance d in the BK-tree of the node's shard, or -1. ``roots``: the first code of each
    code's shard, which is its tree's root; every code is a node."""
    child = np.full((len(codes), 65), -1, dtype=np.int32)
    rest = np.flatnonzero(roots != np.arange(len(codes)))
    node = roots[rest]
    while len(rest):
        edge = np.bitwise_count(codes[rest] ^ codes[node])
        order = np.lexsort((edge, node))
        rest, node, edge = rest[order], node[order], edge[order]
        first = starts([node, edge])
        heads = rest[first]
        child[node[first], edge[first]] = heads
        node = heads[np.cumsum(first) - 1]
        rest, node = rest[~first], node[~first]
    return child


def near(codes: np.ndarray, roots: np.ndarray, child: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i > j, of codes of one shard that differ in ``radius`` bits or fewer."""
    sizes = np.bincount(roots, minlength=len(codes))[roots]
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(codes):
        end = max(begin + 1, int(np.searchsorted(ends, VISITS + ends[begin] - sizes[begin], side="right")))
        asked = np.arange(begin, end)
        node = roots[begin:end]
        begin = end
        while len(asked):
            d = np.bitwise_count(codes[asked] ^ codes[node]).astype(np.int64)
            hit = (d <= radius) & (asked > node)
            if hit.any():
                yield asked[hit], node[hit]
            below = [(asked[ok], child[node[ok], d[ok] + step]) for step in range(-radius, radius + 1) if (ok := (d + step > 0) & (d + step <= 64)).any()]
            asked, node = (np.concatenate(x) for x in zip(*[(a[c >= 0], c[c >= 0]) for a, c in below], strict=True)) if below else (asked[:0], node[:0])


def stars(codes: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each code that has a link within its shard, beside the first code of its component there."""
    label = np.arange(len(codes))
    for a, b in near(codes, roots, trees(codes, roots), radius):
        while True:
            one, two = label[a], label[b]
            apart = one != two
            if not apart.any():
                break
            low = np.minimum(one, two)
            np.minimum.at(label, np.maximum(one, two)[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]
    own = np.flatnonzero(label != np.arange(len(codes)))
    return codes[own], codes[label[own]]


def links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: edges that join what the links between the distinct ``codes`` (fp) join."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero(starts(columns[:2]))
            sizes = np.diff(np.append(new, len(columns[0])))
            several = np.repeat(sizes > 1, sizes)
            sizes = sizes[sizes > 1]
            if len(sizes):
                a, b = stars(columns[2][several].view(np.uint64), np.repeat(np.cumsum(sizes) - sizes, sizes), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        held = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(held, ("mask", "part", "fp"), strict=True)]
            if len(held[0]) >= RUN:
                cut = np.flatnonzero(starts(held[:2]))[-1]  # the last shard may go on
                yield from told([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        yield from told(held)

    found = None
    for rows in shards(codes, radius):
        dealt = rows.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        more = dealt.mapInArrow(search, "a long, b long")
        found = more if found is None else found.union(more)
    return found


def near_duplicates(docs: DataFrame, key: str, text: str, n: int = 3, radius: int = 2) -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id (the smallest key that links lead to) for every row."""
    rows = written(fingerprints(docs, key, text, n), "fingerprints")
    codes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    members = connected_components(links(codes.select("fp"), radius)).select(F.col("doc").alias("_fp"), "component")
    placed = codes.join(members, F.col("fp") == F.col("_fp"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = written(placed, "components")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "_component")
    placed = placed.join(least, F.col("component") == F.col("_component")).select(F.col("fp").alias("_fp"), "component_id")
    joined = rows.join(placed, F.col("fp") == F.col("_fp"))
    return joined.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")

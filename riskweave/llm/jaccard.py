"""N-gram Jaccard join with signature trees, and the components of its links.

A document's set holds its distinct SHINGLE-word shingles, as 64-bit names. Two documents link when 100 times the
intersection is at least SHARE times the union.

Blocks. Sets that link differ in at most H = (100 - SHARE) / (100 + SHARE) * (|x| + |y|) shingles. Names are dealt into
m > H ranges, so some ranges hold the same names in both. Each document sends one key for each range, made of the
names in it, so linked documents share a key; that is exact, with nothing dropped. (A range that is empty in both
would say nothing: m leaves room for some.) Shingles that make up a FREQUENT-th of all or more are left out of the
ranges, which keeps that true, so that documents don't meet over a passage that many have. A document with too many
empty ranges, as all its shingles are frequent or as chance has it, also sends keys made of all its shingles, with
other salts if need be; two documents that have no other key in common both do. Sizes are grouped in bands, and a document sends keys for its band and, if it may link upwards, for the next.
What differs can spoil H ranges only, so documents that link share f - H keys at least, f being the ranges in which one
of them has shingles. Documents that share fewer keys with others have no link and go; that is counted twice, as those
that went may take others with them. The rest, directly or over others, form blocks by their shared keys. Equal sets are
one class, by a 128-bit name; its least document stands for it in all that.

Trees. Within a block, documents are leaves of a tree, ordered by size; every node holds the OR of its leaves' bitmaps,
the range of their sizes and the largest excess of a set over its bits. Two nodes are traversed together and left if
even the largest possible overlap, |A & B| bits plus excess, is too small for the smallest sizes, or if their leaves
are in one component already. Leaves that remain are compared exactly.

Blocks of more than CHUNK shingles are split. First each part is joined with itself, then the least members of the
parts' components. Where a block still has several components, its documents are joined key by key, as only those that
share a key may link: for each key that several components have (of keys with the same documents one), the documents
outside its largest component with all of the key's, part by part. So a block of near copies takes work in proportion to
its size, and no link between different components is lost.

Null ids: such rows have a size, link with nothing and get a null component. Null texts, and texts without words, have
an empty set and link with nothing. Rows that share an id count as one document. Of equal sets the smallest id stands for
all. A long text makes a chunk of its own. An empty table gives an empty result; only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import BATCH_BYTES, bounded_batches, slices, table, written
from riskweave.llm.graph import connected_components
from riskweave.llm.words import Meetings, chunks, grams, mix, starts

SHINGLE = 4
SHARE = 85
GROWTH = 1.5  # from a band's least size to the next one's
SALTS = 8
FREQUENT = 1_000_000  # so at most as many shingles are frequent: 8 MB to broadcast, whatever the input
CHUNK = 1 << 20  # shingles of a tree
FAN = 8
PAIRS = 1024  # node pairs expanded at a time
MAP_BITS = 28  # of all bitmaps of a tree's leaves, as a power of two
NEED_BITS = 40
ASK, KNOWN, SIZE = 0, 1, 2
_ROWS = "kind byte, a long, b long, c long, d long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_table(share: int) -> list[tuple[int, int, int]]:
    """(least size, most differing shingles, ranges) of each band, up to sizes of 2**40."""
    out, least = [], 1
    while least < 1 << 40:
        after = max(least + 1, int(least * GROWTH))
        differ = (100 - share) * 2 * (after - 1) // (100 + share)
        out.append((least, differ, differ + 1 + (1 + differ // 6 if differ else 0)))
        least = after
    return out


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: number of the first, names (sorted in each text) and where each text's begin."""
    for chunk in chunks(texts):
        names = chunk.hashes(lower=True)
        all_of = grams(names, n)
        at = np.flatnonzero(chunk.text_of[: len(all_of)] == chunk.text_of[n - 1 :]) if len(all_of) else np.zeros(0, dtype=np.int64)
        values, of = [all_of[at]], [chunk.text_of[at]]
        for size in range(1, n):  # texts with fewer words: all of them as one
            short = np.flatnonzero(chunk.counts == size)
            if len(short):
                values.append(mix(grams(names, size)[chunk.word_from[short]] + np.uint64(size)))
                of.append(short)
        value, text = np.concatenate(values), np.concatenate(of)
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[new], text[new]
        yield chunk.first, value, np.searchsorted(text, np.arange(chunk.n + 1))


def set_names(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set."""
    out = []
    for odd in (_ODD, np.uint64(0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(values * odd))))
        out.append(mix(sums[begins[1:]] - sums[begins[:-1]]))
    return out[0], out[1]


def block_keys(values: np.ndarray, begins: np.ndarray, rare: np.ndarray, bands: list[tuple[int, int, int]], share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of some sets, the set of each key, and its round and how many keys of that round a link needs, as one number.

    Rare shingles come first, all shingles (salts from 1) if need be.
    """
    sizes = np.diff(begins)
    starts, differ, ranges = (np.array(x) for x in zip(*bands, strict=True))
    own = np.searchsorted(starts, sizes, side="right") - 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    keys, sets, needs = [], [], []
    for step in (0, 1):
        band = np.minimum(own + step, len(bands) - 1)
        open_ = sizes > 0
        if step:
            open_ &= 100 * sizes >= share * starts[band]
        for salt in range(SALTS + 1):
            if not open_.any():
                break
            at = np.flatnonzero(open_[of] & rare) if salt == 0 else np.flatnonzero(open_[of])
            text, value = of[at], values[at]
            place = mix(value + np.uint64(salt * 0xA0761D6478BD642F % 2**64)) >> np.uint64(32)
            place = (place * ranges[band[text]].astype(np.uint64)) >> np.uint64(32)
            cell = (text.astype(np.uint64) << np.uint64(32)) + place
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, dtype=np.int64)
            total = np.add.reduceat(mix(value * _ODD + np.uint64(salt + 1)), first) if len(cell) else value
            cell = cell[first]
            row = (cell >> np.uint64(32)).astype(np.int64)
            tag = (cell & np.uint64(0xFFFFFFFF)) + (band[row].astype(np.uint64) << np.uint64(40)) + (np.uint64(salt) << np.uint64(56))
            keys.append(mix(total + mix(tag)))
            sets.append(row)
            filled = np.bincount(row, minlength=len(sizes))
            round_ = step * (SALTS + 2) + salt
            needs.append((round_ << NEED_BITS) + np.maximum(1, filled - differ[band])[row])
            open_ &= (ranges - differ)[band] <= ranges[band] - filled
        left = np.flatnonzero(open_)  # by chance in all salts: next to none
        keys.append(mix(band[left].astype(np.uint64) * _ODD + np.uint64(12345)))
        sets.append(left)
        needs.append(np.full(len(left), (step * (SALTS + 2) + SALTS + 1 << NEED_BITS) + 1))
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(needs)


def _counts(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shingles that are frequent in a batch, with their counts there, and the number of all under a null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for chunk in chunks(batch.column(0).to_pylist()):  # a batch is of bounded size
                all_of = grams(chunk.hashes(lower=True), n)
                if len(all_of):
                    found.append(all_of[chunk.text_of[: len(all_of)] == chunk.text_of[n - 1 :]])
            value = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(first, len(value)))
            keep = times >= max(2, len(value) / FREQUENT)
            names = pa.array([None, *value[first[keep]].view(np.int64).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(([len(value)], times[keep])), pa.int64())], names=["name", "times"])

    return count


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted names of the shingles that are known to make up a FREQUENT-th of all, so FREQUENT at most.

    What is frequent in all is frequent in some batch, by its share of the batch; only such counts leave the tasks. Which
    shingles are found here has no bearing on the result, only on the work.
    """
    counts = written(docs.select("text").mapInArrow(_counts(n), "name long, times long").groupBy("name").agg(F.sum("times").alias("times")), "jaccard-counts")
    total = counts.where("name IS NULL").agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    often = counts.where(F.col("name").isNotNull() & (F.col("times") >= max(16, total / FREQUENT))).select("name")
    return np.sort(often.toPandas()["name"].to_numpy(dtype=np.int64).view(np.uint64))


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    zero = np.zeros(n, dtype=np.int64)
    arrays = [x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64()) for x in [*columns, zero, zero, zero][:4]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int8)), *arrays], names=["kind", "a", "b", "c", "d"])


def _emit(n: int, share: int, frequent: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """SIZE rows (doc, size, name); KNOWN rows (doc, key, need) for keys that several documents of a batch have; ASK rows
    (key, doc, need) for the least document of each key in the batch."""
    bands = band_table(share)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent()
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                yield from emitted(part, often)

    def emitted(batch: pa.RecordBatch, often: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, valid = batch.column(0), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        doc = ids.fill_null(0).to_numpy()
        keys, docs, needs = [np.zeros(0, dtype=np.uint64)], [doc[:0]], [doc[:0]]
        seen: set[tuple[int, int]] = set()
        for first, values, begins in shingle_sets(batch.column(1).to_pylist(), n):
            sizes = np.diff(begins)
            one, two = set_names(values, begins)
            yield _rows(SIZE, ids[first : first + len(sizes)], sizes, one, two)
            fresh = valid[first : first + len(sizes)].copy()
            for i in np.flatnonzero(fresh):  # equal sets of a batch send keys once
                name = (int(one[i]), int(two[i]))
                fresh[i] = name not in seen
                seen.add(name)
            own = values[np.repeat(fresh, sizes)]
            key, of, need = block_keys(own, np.concatenate(([0], np.cumsum(sizes * fresh))), ~_is_in(own, often), bands, share)
            keys.append(key)
            docs.append(doc[first + of])
            needs.append(need)
        key, of, need = np.concatenate(keys), np.concatenate(docs), np.concatenate(needs)
        order = np.lexsort((of, key))
        key, of, need = key[order], of[order], need[order]
        later, several, _ = Meetings().feed([key], of)
        asks = starts([key])
        yield _rows(ASK, key[asks], of[asks], need[asks])
        yield _rows(KNOWN, of[several], key[several], need[several])

    return emit


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """KNOWN rows for what documents of different batches share; the partition holds all rows of its keys, in order."""
    meetings = Meetings()
    for batch in batches:
        ask = pc.equal(batch.column(0), ASK)
        others = batch.filter(pc.invert(ask))
        if others.num_rows:
            yield others
        key, doc, need = (batch.column(i).filter(ask).to_numpy() for i in (1, 2, 3))
        _, several, owed = meetings.feed([key], doc, need)
        yield _rows(KNOWN, owed[1], owed[0], owed[2])
        yield _rows(KNOWN, doc[several], key[several], need[several])


def linkable(known: DataFrame) -> DataFrame:
    """doc, key, need and the least document of each key, for documents that share enough keys to have a link."""
    held = known
    for _ in range(2):
        round_, least = F.shiftright("need", NEED_BITS), F.col("need").bitwiseAND((1 << NEED_BITS) - 1)
        able = held.groupBy("doc", "need").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("doc").alias("_doc")).distinct()
        held = written(held.join(able, F.col("doc") == F.col("_doc")).select("doc", "key", "need"), "jaccard-able")
        # As a table, so that the join deals both sides out anew and may split a key that very many documents have.
        leads = written(held.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("_top")).where("lead < _top").drop("_top").withColumnRenamed("key", "_key"), "jaccard-leads")
        held = written(held.join(leads, F.col("key") == F.col("_key")).select("doc", "key", "need", "lead"), "jaccard-shared")
    return held


class Tree:
    """Signature tree over sets in order of size: level 0 holds the sets, each level FAN times fewer nodes."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        bits = 9
        while bits < 15 and 1 << bits < 4 * int(sizes.max(initial=1)):
            bits += 1
        while bits > 6 and len(sets) << bits > 1 << MAP_BITS:  # many short sets beside a long one: narrower maps, the same links
            bits -= 1
        packed = np.zeros((len(sets), 1 << bits >> 6), dtype=np.uint64)
        if len(sets):
            place = np.concatenate(sets) >> np.uint64(64 - bits)
            np.bitwise_or.at(packed, (np.repeat(np.arange(len(sets)), sizes), (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        excess = sizes - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        self.levels = [(packed, sizes, sizes, excess)]
        while len(packed) > 1:
            cuts = np.arange(0, len(packed), FAN)
            packed = np.bitwise_or.reduceat(packed, cuts, axis=0)
            low, high, excess = (f.reduceat(x, cuts) for f, x in zip((np.minimum, np.maximum, np.maximum), self.levels[-1][1:], strict=True))
            self.levels.append((packed, low, high, excess))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
        """Whether some leaves below nodes i and j can overlap enough."""
        packed, low, high, excess = self.levels[level]
        out = (100 * high[i] >= share * low[j]) & (100 * high[j] >= share * low[i])
        at = np.flatnonzero(out)
        step = max(1, (1 << 20) // packed.shape[1])
        for a in range(0, len(at), step):
            x, y = i[at[a : a + step]], j[at[a : a + step]]
            most = np.bitwise_count(packed[x] & packed[y]).sum(axis=1, dtype=np.int64) + np.minimum(excess[x], excess[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            out[at[a : a + step]] = most * (100 + share) >= share * (low[x] + low[y])
        return out


def tree_join(sets: list[np.ndarray], labels: np.ndarray, share: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join the components of ``labels`` as far as links do: each set that has joined another component, with
    the first set of all. With ``cross``, links only between its two values."""
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], [len(s) for s in sets]))
    sets = [sets[i] for i in order]
    labels = np.unique(labels, return_inverse=True)[1][order].copy()
    side = None if cross is None else cross[order]
    tree, before = Tree(sets), labels.copy()
    top = len(tree.levels) - 1
    i = j = np.zeros(1, dtype=np.int64)
    for level in range(top, 0, -1):
        keep = tree.may_link(level, i, j, share)
        i, j = i[keep], j[keep]
        if level == 1:
            break
        i, j = _children(i, j, len(tree.levels[level - 1][1]))
    if top == 0:
        return []
    parent = list(range(int(labels.max()) + 1))  # of the components, as they join

    def top_of(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    cuts, now = np.arange(0, len(sets), FAN), labels
    for a in range(0, len(i), PAIRS):
        now = np.fromiter(map(top_of, range(len(parent))), dtype=np.int64, count=len(parent))[labels]
        low, high = np.minimum.reduceat(now, cuts), np.maximum.reduceat(now, cuts)
        x, y = i[a : a + PAIRS], j[a : a + PAIRS]
        apart = (np.minimum(low[x], low[y]) != np.maximum(high[x], high[y]))  # else all leaves are in one component
        x, y = _children(x[apart], y[apart], len(sets))
        keep = (x != y) & (now[x] != now[y])
        if side is not None:
            keep &= side[x] != side[y]
        x, y = x[keep], y[keep]
        keep = tree.may_link(0, x, y, share)
        x, y = x[keep], y[keep]
        by = np.argsort(x, kind="stable")
        for u, v in zip(x[by].tolist(), y[by].tolist(), strict=True):
            one_top, two_top = top_of(int(labels[u])), top_of(int(labels[v]))
            if one_top == two_top:
                continue
            one, two = sets[u], sets[v]
            both = int(np.count_nonzero(one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two))
            if 100 * both >= share * (len(one) + len(two) - both):
                parent[max(one_top, two_top)] = min(one_top, two_top)
    labels = np.fromiter(map(top_of, range(len(parent))), dtype=np.int64, count=len(parent))[labels]
    out, changed = [], np.isin(labels, labels[labels != before])
    at = np.flatnonzero(changed)
    at = at[np.lexsort((at, before[at], labels[at]))]
    heads = np.flatnonzero(np.concatenate(([True], before[at][1:] != before[at][:-1]))) if len(at) else at  # one set of each component that has joined
    held = None
    for k in at[heads].tolist():
        if labels[k] != held:
            held, lead = labels[k], int(order[k])
        else:
            out.append((lead, int(order[k])))
    return out


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children, each once, of pairs with i <= j."""
    k = np.arange(FAN)
    x = np.repeat(i[:, None] * FAN + k, FAN, axis=1).reshape(-1)
    y = np.tile(j[:, None] * FAN + k, (1, FAN)).reshape(-1)
    keep = (x <= y) & (x < n) & (y < n)
    return x[keep], y[keep]


def _join_groups(n: int, share: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each run of rows with equal first ``width`` columns; then come side, label, doc and text."""

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        sets: list[np.ndarray] = []
        for _, values, begins in shingle_sets([r[3] for r in rows], n):
            sets += [values[a:b].copy() for a, b in zip(begins[:-1], begins[1:], strict=True)]
        doc, side = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[0] for r in rows])
        links = tree_join(sets, np.array([r[1] for r in rows], dtype=np.int64), share, side if side.any() else None)
        return pa.RecordBatch.from_arrays([pa.array(doc[[x[k] for x in links]], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                for row in zip(*(c[a : a + 512].to_pylist() for c in batch.columns), strict=True):
                    if row[:width] != held:
                        if len(rows) > 1:
                            yield finish(rows)
                        held, rows = row[:width], []
                    rows.append(row[width:])
        if len(rows) > 1:
            yield finish(rows)

    return join


def _tree_links(docs: DataFrame, members: DataFrame, keys: list[str], n: int, share: int) -> DataFrame:
    """Links of each group of ``members`` (keys, side, label, doc)."""
    # The same kind of join at every size; the members grow with the documents.
    rows = docs.join(members.hint("merge"), F.col("doc_id") == F.col("doc")).select(*keys, "side", "label", "doc", "text")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "doc")
    return rows.mapInArrow(_join_groups(n, share, len(keys)), "a long, b long")


def _parts(members: DataFrame, fewest: int = 2) -> DataFrame:
    """Adds ``parts``, how many trees the block's rows (block, doc, size) make, and each row's ``part``.

    Blocks of less than ``fewest`` rows go: one row has no link where a set is joined with itself.
    """
    total = members.groupBy("block").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    total = total.where(F.col("n") >= fewest).withColumnRenamed("block", "_block")
    rows = members.join(total, F.col("block") == F.col("_block"))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).drop("_block", "n")


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    bounded_batches(df)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    often = df.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))
    rows = docs.mapInArrow(_emit(n, share, lambda: often.value), _ROWS)
    found = written(rows.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_meet, _ROWS), "jaccard-keys")
    sizes = found.where(F.col("kind") == SIZE).select(F.col("a").alias("doc"), F.col("b").alias("size"), "c", "d")
    able = sizes.where("doc IS NOT NULL AND size > 0")
    # As a table, so that the join deals both sides out anew and may split a class with very many copies.
    least = written(able.groupBy("c", "d").agg(F.min("doc").alias("least")), "jaccard-least")
    classes = written(able.join(least, ["c", "d"]).select("doc", "size", "least"), "jaccard-classes")
    equal = classes.where("doc != least").select(F.col("least").alias("a"), F.col("doc").alias("b"))
    known = found.where(F.col("kind") == KNOWN).select(F.col("a").alias("_doc"), F.col("b").alias("key"), F.col("c").alias("need"))
    known = known.join(classes, F.col("doc") == F.col("_doc")).groupBy(F.col("least").alias("doc"), "key").agg(F.max("need").alias("need"))
    shared = linkable(known)
    edges = shared.where("doc != lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))
    blocks = connected_components(edges).toDF("_doc", "block")
    heads = classes.where("doc = least").select("doc", "size").distinct()
    members = written(_parts(heads.join(blocks, F.col("doc") == F.col("_doc")).drop("_doc")), "jaccard-blocks")
    plain = members.withColumns({"side": F.lit(0), "label": F.col("doc")})
    links = written(_tree_links(docs, plain, ["block", "part"], n, share), "jaccard-links")
    large = members.where("parts > 1")
    if not large.isEmpty():
        links = links.union(_large_blocks(docs, large, shared, links, n, share))
    parts = connected_components(links.union(equal)).toDF("_doc", "component")
    rows = sizes.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"))
    joined = rows.join(parts, F.col("doc_id") == F.col("_doc"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    now = connected_components(links).toDF("_doc", "component")
    return members.join(now, F.col("doc") == F.col("_doc"), "left").withColumn("label", F.coalesce("component", "doc")).drop("_doc", "component")


def _large_blocks(docs: DataFrame, large: DataFrame, shared: DataFrame, links: DataFrame, n: int, share: int) -> DataFrame:
    """Further links of blocks that make several trees, such that no two of their components have a link left."""
    now = written(_labelled(large.select("block", "doc", "size"), links), "jaccard-large")
    tops = _parts(now.where("doc = label").select("block", "doc", "size")).withColumns({"side": F.lit(0), "label": F.col("doc")})
    more = written(_tree_links(docs, tops, ["block", "part"], n, share), "jaccard-links")
    now = written(_labelled(large.select("block", "doc", "size"), links.union(more)), "jaccard-large")
    left = now.groupBy("block").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select(F.col("block").alias("_block"))
    if left.isEmpty():
        return more
    rows = now.join(left, F.col("block") == F.col("_block")).select(F.col("doc").alias("_doc"), "size", "label")
    by_key = written(shared.select("doc", "key").join(rows, F.col("doc") == F.col("_doc")).drop("_doc"), "jaccard-by-key")
    # One of the keys that have the same documents, of those with several components.
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "doc")).alias(f"mark{salt}")
    open_ = by_key.groupBy("key").agg(mark(1), mark(2), F.count(F.lit(1)).alias("n"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    open_ = written(open_.groupBy("mark1", "mark2", "n").agg(F.min("key").alias("block")).select("block"), "jaccard-open-keys")
    groups = written(_parts(by_key.join(open_, F.col("key") == F.col("block")).drop("key"), fewest=1), "jaccard-key-groups")
    weights = groups.groupBy("block", "label").agg(F.sum("size").alias("weight"))
    main = weights.groupBy(F.col("block").alias("_block")).agg(F.max_by("label", F.struct("weight", "label")).alias("main"))
    marked = groups.join(main, F.col("block") == F.col("_block")).drop("_block")
    small = marked.where("parts = 1").select("block", F.lit(0).alias("cut"), "part", F.lit(0).alias("side"), "label", "doc")
    # Joined with the whole group, so a single document counts as well.
    wide = marked.where("parts > 1")
    minor = _parts(wide.where("label != main").select("block", "doc", "size", "label"), fewest=1)
    cuts = minor.select(F.col("block").alias("_block"), F.col("part").alias("cut")).distinct()
    others = wide.select(F.col("block").alias("_block"), F.col("part").alias("_part")).distinct()
    left_side = minor.select("block", F.col("part").alias("cut"), "doc", "label").join(others, F.col("block") == F.col("_block"))
    left_side = left_side.select("block", "cut", F.col("_part").alias("part"), F.lit(0).alias("side"), "label", "doc")
    right_side = wide.join(cuts, F.col("block") == F.col("_block")).select("block", "cut", "part", F.lit(1).alias("side"), "label", "doc")
    return more.union(written(_tree_links(docs, small.union(left_side).union(right_side), ["block", "cut", "part"], n, share), "jaccard-links"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, n: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """Rows of the documents table without those whose component has a smaller document."""
    parts = similar_components(docs, n=n, share=share)
    losers = parts.where("component_id != doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(losers, docs["doc_id"] == losers["_id"], "left_anti")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)
), r AS (
  SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id
"""

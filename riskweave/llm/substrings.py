"""Substring dedup by recompression.

Every text is parsed in rounds, as in recompression of grammars: first each maximal run of one symbol gets a new name,
then each pair of a "left" symbol followed by a "right" one, where a bit of the symbol's name says which it is. A
name is a 64-bit hash of what it stands for, so all tasks of all rounds give equal things equal names without a
global dictionary. Equal substrings therefore get equal symbols in their interior, whatever surrounds them.

Reveal: each symbol carries its context, the words that alone decide that it is formed. Each window of WINDOW words
picks one low symbol whose context lies inside it (by round and hash, so equal windows pick equal symbols). Symbols of
LONG words or more, and the root that stands for a whole text, stand for long repeats. Tasks send one row for each
symbol, with the least document; a shuffle by name tells documents which of their symbols others share.

Verify: only windows whose picked symbol is shared, and those that have none, are named themselves and shuffled; a
window is removed where a smaller document has it. Windows inside a long symbol that a smaller document has are
settled without that. What removes words, a window or a long symbol, goes by two independent names of 64 and 32 bits, both
made of its words; so two different windows are taken for one with a chance of 2**-96 a pair (0.001 such pairs are to be
expected among 1.5e13 windows, as 100 TB hold).

Before each shuffle a task keeps one row for a name and batch of rows, so a name that a third of all documents
have sends one row from each batch. Behind it Spark sorts each partition by name, and the rows are read in that order, so
no partition is held in a worker.

Rows with a null id remove nothing from others and lose nothing; null texts have no words. Of equal windows those of the
smallest id stay, all of them. Rows that share an id count as one document. A long text makes a chunk of its own, parsed as
a whole. An empty table gives an empty result; only the id and the text are read, and kept columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import BATCH_BYTES, bounded_batches, slices, table
from riskweave.llm.words import Chunk, Meetings, chunks, mix, powers, starts

WINDOW = 13
LONG = 52  # words of a symbol that settles windows by itself
PICK_ROUNDS = 2
MOST_ROUNDS = 64
_FAR = 1 << 60
ASK, KNOWN, SPAN = 0, 1, 2


def span_names(names: np.ndarray, begins: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A name for the words from begins to ends; with ``other``, one of 32 bits that is independent of the first."""
    if other:
        return span_names(mix(names ^ np.uint64(0xA3B195354A39B70D)), begins, ends) >> np.uint64(32)
    up, down = powers(len(names) + 1)
    sums = np.zeros(len(names) + 1, dtype=np.uint64)
    np.cumsum(names * up[: len(names)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins])


class Symbols:
    """The symbols of one round: name, words [begin, end), text, and the words [low, high) that decide them."""

    def __init__(self, name, begin, end, text, low, high):
        self.name, self.begin, self.end, self.text, self.low, self.high = name, begin, end, text, low, high

    def runs(self) -> tuple[Symbols, np.ndarray]:
        """Name maximal runs; also, which symbols are new."""
        n = len(self.name)
        new = np.ones(n, dtype=bool)
        same = self.text[1:] == self.text[:-1]
        new[1:] = (self.name[1:] != self.name[:-1]) | ~same
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        size = last - first + 1
        many = size > 1
        name = self.name[first].copy()
        name[many] = mix(name[many] + size[many].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        # A run is known to end only where a different neighbour is known.
        low = np.full(len(first), -_FAR)
        high = np.full(len(first), _FAR)
        inner = np.flatnonzero(self.text[first[1:] - 1] == self.text[first[1:]]) + 1
        low[inner] = self.low[first[inner] - 1]
        inner = np.flatnonzero(self.text[last[:-1] + 1] == self.text[last[:-1]])
        high[inner] = self.high[last[inner] + 1]
        return Symbols(name, self.begin[first], self.end[last], self.text[first], low, high), many

    def pairs(self, round_no: int) -> tuple[Symbols, np.ndarray]:
        """Name pairs of a left and a right symbol; also, which symbols are new."""
        n = len(self.name)
        right = (mix(self.name + np.uint64(round_no * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)).astype(bool)
        near = np.zeros(n, dtype=bool)  # has a next symbol in the text
        near[:-1] = self.text[1:] == self.text[:-1]
        joins = near & ~right
        joins[:-1] &= right[1:]
        low, high = self.low.copy(), self.high.copy()
        # A symbol that stays alone does so because of its neighbour on the side on which it could pair.
        alone = ~right & ~joins
        at = np.flatnonzero(alone[:-1] & near[:-1])
        high[at] = np.maximum(high[at], self.high[at + 1])
        high[alone & ~near] = _FAR
        taken = np.zeros(n, dtype=bool)
        taken[1:] = joins[:-1]
        alone = right & ~taken
        before = np.zeros(n, dtype=bool)
        before[1:] = near[:-1]
        at = np.flatnonzero(alone & before)
        low[at] = np.minimum(low[at], self.low[at - 1])
        low[alone & ~before] = -_FAR
        at = np.flatnonzero(joins)
        name, end = self.name.copy(), self.end.copy()
        name[at] = mix(name[at] * np.uint64(0xE7037ED1A0B428DB) + name[at + 1] * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(1))
        end[at] = end[at + 1]
        low[at] = np.minimum(low[at], low[at + 1])
        high[at] = np.maximum(high[at], high[at + 1])
        stay = ~taken
        return Symbols(name[stay], self.begin[stay], end[stay], self.text[stay], low[stay], high[stay]), joins[stay]


class Parse:
    """What the rounds give for a chunk: the window's picks, and long symbols."""

    def __init__(self, chunk: Chunk, names: np.ndarray, window: int, long: int):
        n = len(names)
        at = np.arange(n)
        symbols = Symbols(names, at, at + 1, chunk.text_of, at, at + 1)
        self.windows = np.flatnonzero(chunk.text_of[: max(0, n - window + 1)] == chunk.text_of[window - 1 :]) if n >= window else at[:0]
        self.pick = np.full(len(self.windows), -1)  # an index into the two below, or -1
        self.low, self.high, held = [at[:0]], [at[:0]], 0
        self.long_name, self.long_begin, self.long_end, self.long_text = [], [], [], []
        picks = []
        for round_no in range(1, MOST_ROUNDS + 1):
            size = len(symbols.name)
            for step in (lambda s: s.runs(), lambda s: s.pairs(round_no)):
                before = symbols
                symbols, new = step(before)
                length = symbols.end - symbols.begin
                grown = np.flatnonzero(new & (length >= long))
                if len(grown):  # only the first time: no part was long already
                    part = before.end - before.begin >= long
                    sums = np.concatenate(([0], np.cumsum(part)))
                    of = np.searchsorted(before.begin, symbols.begin[grown])
                    to = np.searchsorted(before.begin, symbols.end[grown])
                    self._long(symbols, grown[sums[to] == sums[of]])
            if round_no <= PICK_ROUNDS:
                picks.append(symbols)
            if len(symbols.name) == size and round_no > PICK_ROUNDS or size == len(np.unique(symbols.text)):
                break
        alone = np.flatnonzero(np.bincount(symbols.text, minlength=chunk.n)[symbols.text] == 1)
        self._long(symbols, alone[symbols.end[alone] - symbols.begin[alone] >= window])  # roots
        self.long_name, self.long_begin, self.long_end, self.long_text = (
            np.concatenate(x) if x else np.zeros(0, dtype=kind)
            for x, kind in ((self.long_name, np.uint64), (self.long_begin, np.int64), (self.long_end, np.int64), (self.long_text, np.int64))
        )
        for level in reversed(picks):  # the highest round that has one inside the window decides
            held = self._pick(level, n, window, held)
        self.low, self.high = np.concatenate(self.low), np.concatenate(self.high)
        used = np.unique(self.pick[self.pick >= 0])
        self.names = np.zeros(held, dtype=np.uint64)
        self.names[used] = span_names(names, self.low[used], self.high[used]) & ~np.uint64(1)
        self.used, self.text_of = used, chunk.text_of
        self.long_other = span_names(names, self.long_begin, self.long_end, other=True)

    def _long(self, symbols: Symbols, at: np.ndarray) -> None:
        self.long_name.append(symbols.name[at] | np.uint64(1))
        self.long_begin.append(symbols.begin[at])
        self.long_end.append(symbols.end[at])
        self.long_text.append(symbols.text[at])

    def _pick(self, level: Symbols, n: int, window: int, held: int) -> int:
        keep = level.high - level.low <= window
        low, high, begin = level.low[keep], level.high[keep], level.begin[keep]
        rank = mix(level.name[keep]) >> np.uint64(1)
        worst = np.uint64(2**64 - 1)
        by_low, by_high, by_rank, by_index = np.full(n, -1), np.full(n, _FAR), np.full(n, worst, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        by_low[begin], by_high[begin], by_rank[begin], by_index[begin] = low, high, rank, held + np.arange(len(begin))
        open_ = np.flatnonzero(self.pick < 0)
        p = self.windows[open_]
        best = np.full(len(p), worst, dtype=np.uint64)
        pick = np.full(len(p), -1)
        for k in range(window):
            a = p + k
            better = (by_rank[a] < best) & (by_low[a] >= p) & (by_high[a] <= p + window)
            best[better] = by_rank[a[better]]
            pick[better] = by_index[a[better]]
        self.pick[open_] = pick
        self.low.append(low)
        self.high.append(high)
        return held + len(begin)


def lead(keys: np.ndarray, others: np.ndarray, docs: np.ndarray, either: np.ndarray) -> list[np.ndarray]:
    """Rows (key, tag, doc) for a batch: what the batch itself tells is KNOWN, and the least document of a key asks.

    A key with ``either`` is of interest to all its documents if there are two; any other to all but the least.
    """
    ids, rank = np.unique(docs, return_inverse=True)
    rank = rank.astype(np.uint16) if len(ids) < 1 << 16 else rank  # short numbers sort faster
    order = np.lexsort((rank, others, keys))
    keys, others, rank, either = keys[order], others[order], rank[order], either[order]
    new = starts([keys, others, rank])
    keys, others, rank, either = keys[new], others[new], rank[new], either[new]
    later, several, _ = Meetings().feed([keys, others], rank)
    out = np.concatenate((np.flatnonzero(starts([keys, others])), np.flatnonzero(later | (several & either))))
    asks = len(out) - int((later | (several & either)).sum())
    tags = others[out].astype(np.int64)
    tags[asks:] += KNOWN << 32
    return [keys[out], tags, ids[rank[out]]]


def _batch(keys: np.ndarray, tags: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(tags), pa.array(docs)], names=["key", "tag", "doc"])


_ROWS = "key long, tag long, doc long"  # the tag is the kind of row (upper half) and the other name


def _decide(all_even: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers for a partition that holds all rows of its keys, in order. Even keys interest all their documents, if asked for."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meetings = Meetings()
        for batch in batches:
            key, tag, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            told = tag >> 32 != ASK
            yield _batch(key[told], tag[told], doc[told])
            key, tag, doc = key[~told], tag[~told], doc[~told]
            later, several, owed = meetings.feed([key, tag], doc)
            if all_even:
                later = np.where(key & 1 == 0, several, later)
                if len(owed[0]) and owed[0][0] & 1 == 0:
                    yield _batch(owed[0], owed[1] + (KNOWN << 32), owed[2])
            yield _batch(key[later], tag[later] + (KNOWN << 32), doc[later])

    return decide


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str | None]]:
    """Ids and texts of the rows that have an id."""
    batch = batch.filter(batch.column(0).is_valid())
    return batch.column(0).to_numpy(), batch.column(1).to_pylist()


def _reveal(window: int, long: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, texts = _texts(batch)
            keys, others, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)], [ids[:0]]
            for chunk in chunks(texts):
                parse = Parse(chunk, chunk.hashes(), window, long)
                keys += [parse.names[parse.used], parse.long_name]
                others += [np.zeros(len(parse.used), dtype=np.uint64), parse.long_other]
                docs += [ids[chunk.first + parse.text_of[parse.low[parse.used]]], ids[chunk.first + parse.long_text]]
            key = np.concatenate(keys)
            yield _batch(*lead(key, np.concatenate(others), np.concatenate(docs), key & np.uint64(1) == 0))

    return reveal


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, 1, BATCH_BYTES)


def _within(names: np.ndarray, others: np.ndarray, texts: np.ndarray, lists: list[np.ndarray], other_lists: list[np.ndarray]) -> np.ndarray:
    """Whether each (name, other name, text) has its names in the text's lists."""
    if not len(names):
        return np.zeros(0, dtype=bool)
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    known_others = np.concatenate(other_lists).astype(np.int32).view(np.uint32).astype(np.uint64)
    columns = [(np.concatenate(lists).view(np.uint64), names), (known_others, others), (of, texts)]
    name, other, text = (np.concatenate((known.astype(own.dtype), own)) for known, own in columns)
    mine = np.arange(len(text)) >= len(of)
    order = np.lexsort((mine, other, text, name))
    first = starts([name[order], other[order], text[order]])
    listed = ~mine[order][first]  # a list's row comes first among equals
    out = np.empty(len(order), dtype=bool)
    out[order] = listed[np.cumsum(first) - 1]
    return out[len(of) :]


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values, valid = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
    empty = np.zeros(0, dtype=np.int64)
    return [values[a:b] if ok else empty for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def _verify(window: int, long: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            batch = batch.filter(batch.column(0).is_valid())
            ids, texts = _texts(batch)
            shared, shared_other = _lists(batch.column(3)), _lists(batch.column(4))
            keys, others, docs, spans, span_docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)], [ids[:0]], [], []
            for chunk in chunks(texts):
                names = chunk.hashes()
                parse = Parse(chunk, names, window, long)
                here = slice(chunk.first, chunk.first + chunk.n)
                hit = np.zeros(len(parse.names) + 1, dtype=bool)
                hit[-1] = True  # for windows that have no pick
                picked = parse.names[parse.used]
                hit[parse.used] = _within(picked, np.zeros(len(picked), dtype=np.uint64), parse.text_of[parse.low[parse.used]], shared[here], shared_other[here])
                settled = np.flatnonzero(_within(parse.long_name, parse.long_other, parse.long_text, shared[here], shared_other[here]))
                begin, end = parse.long_begin[settled], parse.long_end[settled]
                spans.append((begin - chunk.word_from[parse.long_text[settled]]) << 32 | (end - begin))
                span_docs.append(ids[chunk.first + parse.long_text[settled]])
                open_ = np.zeros(len(names) + 1, dtype=np.int64)  # windows inside settled symbols
                np.add.at(open_, begin, 1)
                np.add.at(open_, end - window + 1, -1)
                at = parse.windows[hit[parse.pick] & (np.cumsum(open_)[parse.windows] == 0)]
                keys.append(span_names(names, at, at + window))
                others.append(span_names(names, at, at + window, other=True))
                docs.append(ids[chunk.first + chunk.text_of[at]])
            key = np.concatenate(keys)
            yield _batch(*lead(key, np.concatenate(others), np.concatenate(docs), np.zeros(len(key), dtype=bool)))
            if spans:
                span = np.concatenate(spans)
                yield _batch(span, np.full(len(span), SPAN << 32), np.concatenate(span_docs))

    return verify


def _strip(window: int, original: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, gone, gone_other, spans = batch.column(1).to_pylist(), *(_lists(batch.column(i)) for i in (3, 4, 5))
            for chunk in chunks(texts):
                names = chunk.hashes()
                n, here = len(names), slice(chunk.first, chunk.first + chunk.n)
                removed = np.zeros(n + 1, dtype=np.int64)
                for i, span in enumerate(spans[here]):
                    np.add.at(removed, chunk.word_from[i] + (span >> 32), 1)
                    np.add.at(removed, chunk.word_from[i] + (span >> 32) + (span & 0xFFFFFFFF), -1)
                some = np.zeros(chunk.n, dtype=bool)
                some[:] = [len(x) > 0 for x in gone[here]]
                if some.any():
                    at = np.flatnonzero((chunk.text_of[: n - window + 1] == chunk.text_of[window - 1 :]) & some[chunk.text_of[: n - window + 1]])
                    at = at[_within(span_names(names, at, at + window), span_names(names, at, at + window, other=True), chunk.text_of[at], gone[here], gone_other[here])]
                    np.add.at(removed, at, 1)
                    np.add.at(removed, at + window, -1)
                keep = np.cumsum(removed)[:n] == 0
                raw = chunk.buf.tobytes()
                kept, counts = [], np.zeros(chunk.n, dtype=np.int64)
                for i in range(chunk.n):
                    a, b = chunk.word_from[i], chunk.word_to[i]
                    if original and keep[a:b].all():
                        kept.append(texts[chunk.first + i])
                        continue
                    words = raw[chunk.begins[i] : chunk.ends[i]].split()
                    own = keep[a:b]
                    counts[i] = b - a - np.count_nonzero(own)
                    if counts[i]:
                        words = [w for w, k in zip(words, own.tolist(), strict=True) if k]
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[here], pa.array(chunk.counts.astype(np.int64)), pa.array(counts), pa.array(kept, pa.string()), batch.column(2)[here]],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "rest"],
                )

    return strip


def dedup_substrings(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, long: int = LONG, keep: tuple[str, ...] = (), original: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the kept columns (in a struct ``rest``) for every row.

    kept_text has the words that stay, joined by single spaces; with ``original``, a text that loses nothing stays as it
    is. The texts are shuffled by id once; both joins read that shuffle.
    """
    bounded_batches(df)
    rest = F.struct(*keep) if keep else F.lit(None).cast("boolean")
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), rest.alias("rest"))
    kind = docs.schema["rest"].dataType.simpleString()
    sorted_by_key = lambda rows: rows.repartition("key").sortWithinPartitions("key", "tag", "doc")
    other = F.shiftright(F.shiftleft("tag", 32), 32).cast("int")
    lists = lambda wanted, *names: [F.collect_list(F.when(wanted, c)).alias(alias) for c, alias in names]
    found = sorted_by_key(docs.select("doc_id", "text").mapInArrow(_reveal(window, long), _ROWS)).mapInArrow(_decide(True), _ROWS)
    shared = found.groupBy(F.col("doc").alias("_doc")).agg(*lists(F.lit(True), (F.col("key"), "shared"), (other, "shared_other")))
    asked = docs.join(shared, docs["doc_id"] == shared["_doc"], "left").select("doc_id", "text", "rest", "shared", "shared_other")
    told = sorted_by_key(asked.mapInArrow(_verify(window, long), _ROWS)).mapInArrow(_decide(False), _ROWS)
    is_span = F.shiftright("tag", 32) == SPAN
    gone = told.groupBy(F.col("doc").alias("_doc")).agg(*lists(~is_span, (F.col("key"), "gone"), (other, "gone_other")), *lists(is_span, (F.col("key"), "spans")))
    last = docs.join(gone, docs["doc_id"] == gone["_doc"], "left").select("doc_id", "text", "rest", "gone", "gone_other", "spans")
    return last.mapInArrow(_strip(window, original), f"doc_id long, n_words long, n_removed long, kept_text string, rest {kind}")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents table with what is kept of each text; rows of which nothing is left go, clean texts stay as they are."""
    others = tuple(c for c in docs.columns if c != "text")
    kept = dedup_substrings(docs, keep=others, original=True).where("n_words = 0 OR n_removed < n_words")
    columns = {c: F.col(f"rest.{c}") for c in others} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), m AS (
  SELECT g, min(doc_id) AS least FROM p GROUP BY g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN m USING (g) WHERE least < doc_id
), k AS (
  SELECT w.doc_id, w.ws[t.j] AS word, t.j AS j
  FROM w, LATERAL (SELECT unnest(range(1, len(w.ws) + 1)) AS j) t
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.j = t.j)
), s AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM k GROUP BY doc_id
), r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN r ON w.doc_id = r.doc_id
"""

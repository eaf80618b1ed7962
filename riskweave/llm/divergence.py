"""Source divergence audit by chunk factorization: how far a source's words are from those of the others of its language.

1. Whitespace chunks are counted per document, a unit of about UNIT bytes of texts at a time: a row for each language and
   chunk of a unit has its occurrences by source (a source goes by a 64-bit code until the end), its number of documents and, below ``least`` of them, which ones they are.
2. Those rows meet by chunk. Each globally distinct chunk is cut into terms once, and its counts go to each of its terms.
   Lists of documents are united; from ``least`` documents on they are dropped, as their number no longer matters.
3. Rows of a term are merged in the same way, where they are and then by language and term: occurrences of a term are sums over
   its chunks, and it is kept if one chunk or the union of the rare chunks' lists has ``least`` documents. Nothing is written
   or shuffled any more of terms that aren't kept.
4. Sources are compared in blocks of BLOCK sources. Each kept term of a language has a row for each block, with the
   probabilities of the block's sources; pairs of blocks meet by term, and a batch's contributions are summed in Python
   as whole matrices before they are shuffled.

A hot language adds a row a unit to a chunk, no more, and a term of very many chunks has a row a slab; a chunk's and a term's own counts
have an entry a source, and joins have unique right sides or can be split. Rows that meet are sorted by Spark and merged SLAB bytes at a time. Only counts are shuffled, no texts. What is asked for has a row for each pair of sources, so work on
pairs grows with their number.

Nulls: a null language or source is '', a null text has no terms; its group still counts. A document is a row, so
repeated rows are several documents. Ties rank by the bytes of the item. A long text is counted whole, in a unit of its own if
need be. An empty table gives an empty result; a language without kept terms has pairs of value 0. Columns other than the
three that are named are not read, and may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import bounded_batches, table, written
from riskweave.llm.words import starts

LEAST = 10  # documents of a kept term
TOP = 10  # terms of a group that are told
SCALE = 1_000_000_000
UNIT = 24 << 20
BLOCK = 64
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SLAB = 8 << 20  # bytes of rows that are merged at once
COUNTED = "lang string, chunk string, sources array<long>, ns array<long>, df long, docs array<long>"


def _codes(rows: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    coded = rows[column].combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _lists(sizes: np.ndarray, values: pa.Array, present: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=None if present is None else pa.array(~present))


def _unit(held: list[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of whitespace chunks of some whole documents (id, lang, code of the source, text)."""
    rows = pa.Table.from_batches(held).combine_chunks()
    held.clear()  # texts, words and their copies go as soon as they have served
    words = pc.ascii_split_whitespace(pc.fill_null(rows["text"].cast(pa.large_string()), ""))
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    rows = rows.drop_columns(["text"])
    flat, doc = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
    del words
    coded = flat.dictionary_encode()
    del flat
    # Documents are numbered by language and source, so that one sort puts words by chunk, language, source and document.
    (lang, langs), source = _codes(rows, "lang"), rows["code"].to_numpy()
    lang, order = lang.astype(np.int32), np.lexsort((source, lang)).astype(np.int32)
    place, bits = np.empty(len(order), dtype=np.int32), len(order).bit_length()
    place[order] = np.arange(len(order))
    keys, forms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    del coded
    keys <<= bits
    keys |= place[doc]
    del doc
    pa.default_memory_pool().release_unused()  # what the words took is not needed any more
    keys.sort()
    first = np.flatnonzero(starts([keys]))
    n, keys = np.diff(np.append(first, len(keys))).astype(np.int32), keys[first]
    del first
    if (empty := pc.index(forms, "").as_py()) >= 0:  # before a text's first word and after its last
        filled = keys >> bits != empty
        keys, n = keys[filled], n[filled]
    if not len(keys):
        return
    chunk, doc = (keys >> bits).astype(np.int32), order[keys & ((1 << bits) - 1)]
    del keys
    lang, source = lang[doc], source[doc]
    whole = starts([chunk, lang])
    both, each = np.flatnonzero(whole), np.flatnonzero(whole | starts([source]))
    df = np.diff(np.append(both, len(doc)))
    n, few = np.add.reduceat(n, each, dtype=np.int64), df < least
    per = np.diff(np.append(np.searchsorted(each, both), len(each)))
    out = [
        langs.take(pa.array(lang[both])), forms.take(pa.array(chunk[both])).cast(pa.string()),
        _lists(per, pa.array(source[each])), _lists(per, pa.array(n)), pa.array(df.astype(np.int64)),
        _lists(np.where(few, df, 0), pa.array(rows["id"].to_numpy()[doc[np.repeat(few, df)]]), few),
    ]
    yield from pa.Table.from_arrays(out, names=["lang", "chunk", "sources", "ns", "df", "docs"]).to_batches(max_chunksize=20_000)


def chunk_counts(docs: DataFrame, least: int) -> DataFrame:
    """Rows of COUNTED of (lang, code, text). A row's number serves as the document's; it only has to differ."""
    bounded_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= UNIT:
                yield from _unit(held, least)
                held, size = [], 0
        if held:
            yield from _unit(held, least)

    return docs.select(F.monotonically_increasing_id().alias("id"), "lang", "code", "text").mapInArrow(count, COUNTED)


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each beginning on, as many as its size says."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _packed(per: np.ndarray, source: np.ndarray, n: np.ndarray, listed: np.ndarray, docs: np.ndarray, many: np.ndarray) -> pa.ListArray:
    """One list a row, as a column of its own for each would cost Arrow several times over: the number of sources (negative if
    the documents are too many to be listed), the sources, their counts, and the documents."""
    sizes = 1 + 2 * per + listed
    begins = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), dtype=np.int64)
    out[begins] = np.where(many, -per, per)
    out[_runs(begins + 1, per)], out[_runs(begins + 1 + per, per)], out[_runs(begins + 1 + 2 * per, listed)] = source, n, docs
    return _lists(sizes, pa.array(out))


def _unpacked(counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values, sizes = counts.flatten().to_numpy(), pc.list_value_length(counts).to_numpy().astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    per = np.abs(values[begins])
    listed = sizes - 1 - 2 * per
    at = (_runs(begins + 1, per), _runs(begins + 1 + per, per), _runs(begins + 1 + 2 * per, listed))
    return per, values[at[0]], values[at[1]], listed, values[at[2]], values[begins] < 0


def _merged(rows: pa.Table, least: int) -> pa.Table:
    """One row for each key and language of rows (name, lang, key, counts), in this order: counts of a source are added,
    documents are united, and no longer listed where there are ``least`` of them or more."""
    rows = rows.combine_chunks()
    (lang, langs), (key, keys) = _codes(rows, "lang"), _codes(rows, "key")
    groups, first, at = np.unique(key * len(langs) + lang, return_index=True, return_inverse=True)
    per, source, n, listed, docs, over = _unpacked(rows["counts"].chunk(0))
    coded = pa.array(source).dictionary_encode()
    known, source = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    entry = np.repeat(at, per) * len(known) + source
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    each = np.flatnonzero(starts([entry]))
    group, source = np.divmod(entry[each], len(known))
    counts = [np.bincount(group, minlength=len(groups)), known[source], np.add.reduceat(n[order], each)]

    group = np.repeat(at, listed)
    order = np.lexsort((docs, group))
    group, docs = group[order], docs[order]
    new = starts([group, docs])
    group, docs = group[new], docs[new]
    many = np.bincount(group, minlength=len(groups)) >= least
    many[at[over]] = True
    docs, group = docs[~many[group]], group[~many[group]]
    counts = _packed(*counts, np.bincount(group, minlength=len(groups)), docs, many)
    out = [rows["name"].take(pa.array(first)), langs.take(pa.array(groups % len(langs))), keys.take(pa.array(groups // len(langs))), counts]
    return pa.Table.from_arrays(out, names=["name", "lang", "key", "counts"])


def _met(batches: Iterator[pa.RecordBatch], least: int, slab: int) -> Iterator[pa.Table]:
    """Merged rows of batches in order of the name, about ``slab`` bytes at a time. All rows of a name come in one table; of a name
    that goes on, the rows so far are merged, so they take little room."""
    held, size, most = [], 0, slab
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            rows = _merged(pa.Table.from_batches(held), least)
            last = pc.equal(rows["name"], batch.column("name")[-1])
            yield rows.filter(pc.invert(last))
            held = rows.filter(last).cast(batch.schema).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
            most = max(slab, 2 * size)
    if held:
        yield _merged(pa.Table.from_batches(held), least)


def _by_name(rows: DataFrame, *of: str) -> DataFrame:
    """Rows of (lang, key, counts) by a hash of some columns, the name: those of a name are side by side in one partition."""
    named = rows.repartition(*of).select(F.xxhash64(*of).alias("name"), "lang", "key", "counts")
    return named.sortWithinPartitions("name")


def chunk_terms(units: DataFrame, least: int) -> DataFrame:
    """A row for each term of each distinct chunk: term, k (how often the chunk has it) and found, the chunk's counts in each
    language (see _packed).

    Rows meet by chunk alone, in order of its hash, a slab at a time.
    """
    slab = SLAB

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _met(batches, least, slab):
            rows = rows.combine_chunks()
            if not rows.num_rows:
                continue
            key = rows["key"].chunk(0)
            begins = np.flatnonzero(starts([key.dictionary_encode().indices.to_numpy()]))
            found = pa.StructArray.from_arrays([rows[c].chunk(0) for c in ("lang", "counts")], names=["lang", "counts"])
            out = [key.take(pa.array(begins)), _lists(np.diff(np.append(begins, len(key))), found)]
            yield from pa.Table.from_arrays(out, names=["chunk", "found"]).to_batches(max_chunksize=20_000)

    per = F.size("sources").cast("long")
    head = F.array(F.when(F.col("docs").isNull(), -per).otherwise(per))
    counts = F.concat(head, "sources", "ns", F.coalesce("docs", F.array().cast("array<long>"))).alias("counts")
    chunks = _by_name(units.select("lang", F.col("chunk").alias("key"), counts), "key").mapInArrow(meet, "chunk string, found array<struct<lang: string, counts: array<long>>>")
    lowered = F.translate("chunk", string.ascii_uppercase, string.ascii_lowercase)
    terms = F.sort_array(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))
    # Equal terms are neighbours: how often each occurs is told by where the next one begins. Most chunks are one term, and need
    # no look at neighbours; one without terms gives no row (a filter would cut each chunk a second time).
    begins = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    rows = chunks.select(terms.alias("terms"), "found").withColumn("begins", F.when(F.size("terms") > 1, begins))
    several = F.transform("begins", lambda b, i: F.struct(F.get("terms", b).alias("term"), (F.coalesce(F.get("begins", i + 1), F.size("terms")) - b).alias("k")))
    alone = F.array(F.struct(F.get("terms", F.lit(0)).alias("term"), F.lit(1).alias("k")))
    pairs = F.when(F.size("terms") == 1, alone).when(F.size("terms") > 1, several)
    return rows.select("found", F.explode(pairs).alias("x")).select("x.term", "x.k", "found")


def kept_terms(forms: DataFrame, least: int) -> DataFrame:
    """lang, term, sources and ns of the terms in ``least`` documents of the language or more; forms as chunk_terms gives them.

    Forms of a term are merged where they are, a slab at a time, before rows meet by language and term: a term of very many
    chunks has a row a slab. Its documents are those of a chunk in ``least`` of them or the union of its rare chunks' lists.
    """
    slab = SLAB

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= slab:
                yield from _of_terms(held, least)
                held, size = [], 0
        if held:
            yield from _of_terms(held, least)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _met(batches, least, slab):
            rows = rows.filter(pc.less(pc.list_element(rows["counts"], 0), 0)).combine_chunks()
            if rows.num_rows:
                per, source, n, *_ = _unpacked(rows["counts"].chunk(0))
                out = [rows["lang"], rows["key"], _lists(per, pa.array(source)), _lists(per, pa.array(n))]
                yield from pa.Table.from_arrays(out, names=["lang", "term", "sources", "ns"]).to_batches(max_chunksize=20_000)

    slabs = forms.select("term", "k", "found").mapInArrow(combine, "lang string, key string, counts array<long>")
    return _by_name(slabs, "lang", "key").mapInArrow(meet, "lang string, term string, sources array<long>, ns array<long>")


def _of_terms(held: list[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merged rows (lang, key, counts) of some forms, the key being the term."""
    rows = pa.Table.from_batches(held).combine_chunks()
    if not rows.num_rows:
        return
    held.clear()
    found = rows["found"].chunk(0)
    form = pc.list_parent_indices(found).to_numpy()
    lang, counts = found.flatten().flatten()
    per, source, n, *rest = _unpacked(counts)
    counts = _packed(per, source, n * np.repeat(rows["k"].to_numpy()[form], per), *rest)
    parts = [pa.array(np.zeros(len(form), dtype=np.int64)), lang, rows["term"].chunk(0).take(pa.array(form)), counts]
    rows = _merged(pa.Table.from_arrays(parts, names=["name", "lang", "key", "counts"]), least)
    yield from rows.drop_columns(["name"]).to_batches(max_chunksize=20_000)


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)): no rounding; in decimals where 64 bits might overflow."""
    top = (count + 2).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")
    wide = F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")).cast("long")
    return F.when(count < 2**63 // SCALE - 2, F.call_function("div", (count + 2).cast("long") * SCALE, total + 2 * terms)).otherwise(wide) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """lang, i, j, value: over the rows (lang, a, b, va, vb) of kept terms, the summed distance of each pair of sources, with
    source i in block a and j in block b."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            a, b = (batch.column(c).to_numpy() for c in "ab")
            keys = np.stack([lang.indices.to_numpy(), a, b], axis=1)
            for key in np.unique(keys, axis=0):
                here = pa.array((keys == key).all(axis=1))
                left, right = (batch.column(c).filter(here) for c in ("va", "vb"))
                left, right = (x.flatten().to_numpy().reshape(len(x), -1) for x in (left, right))
                sums = np.stack([((p[:, None] - right) ** 2 // (p[:, None] + right)).sum(axis=0) for p in left.T])
                i, j = np.nonzero(np.ones_like(sums))
                out = [pa.array([lang.dictionary[key[0]].as_py()] * len(i)), pa.array(i + key[1] * BLOCK), pa.array(j + key[2] * BLOCK), pa.array(sums[i, j])]
                yield pa.RecordBatch.from_arrays(out, names=["lang", "i", "j", "value"])

    return vectors.mapInArrow(add, "lang string, i long, j long, value long").where("i < j").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def pair_values(kept: DataFrame, counted: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, i, j (numbers of two sources in their language, i < j) and value. ``groups``: lang, source, total, terms, at."""
    block = F.floor(F.col("at") / BLOCK).alias("block")
    zero = probability(F.lit(0), F.col("total"), F.col("terms"))
    able = groups.where("terms > 0")
    blocks = able.groupBy("lang", block).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", zero.alias("p")))), lambda x: x["p"]).alias("zeros"))
    last = blocks.groupBy("lang").agg(F.max("block").alias("last"))
    blocks = blocks.join(last, "lang").select(F.col("lang").alias("_lang"), F.col("block").alias("_block"), "zeros", "last")
    own = counted.groupBy("lang", "term", block).agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") % BLOCK).cast("int").alias("at"), "p"))).alias("own"))
    own = own.select(F.col("lang").alias("_l"), F.col("term").alias("_t"), F.col("block").alias("_b"), "own")
    # No entry for a source that lacks the term: there the value of count 0 stands.
    dense = F.transform("zeros", lambda zero, i: F.coalesce(F.try_element_at("own", i), zero)).alias("v")
    every = kept.join(blocks, F.col("lang") == F.col("_lang"))
    every = every.join(own, (F.col("lang") == F.col("_l")) & (F.col("term") == F.col("_t")) & (F.col("_block") == F.col("_b")), "left")
    every = every.select("lang", "term", F.col("_block").alias("block"), "last", dense)
    within = every.select("lang", F.col("block").alias("a"), F.col("block").alias("b"), F.col("v").alias("va"), F.col("v").alias("vb"))
    several = every.where("last > 0")
    other = several.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), F.col("block").alias("b"), F.col("v").alias("vb"))
    across = several.join(other, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term")) & (F.col("block") < F.col("b")))
    return _pair_sums(within.union(across.select("lang", F.col("block").alias("a"), "b", F.col("v").alias("va"), "vb")))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of (lang, source, text): see the module's docstring."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text").withColumn("code", F.xxhash64("source"))
    groups = written(docs.select("lang", "source", "code").distinct(), "groups")
    if not groups.groupBy("lang", "code").count().where("count > 1").isEmpty():
        raise ValueError("two sources have one code")  # 2**-64 a pair
    kept = written(kept_terms(chunk_terms(chunk_counts(docs, least), least), least), "kept-terms")
    kept = kept.withColumn("lang_n", F.aggregate("ns", F.lit(0).cast("long"), lambda s, n: s + n))
    counted = kept.select("lang", "term", "lang_n", F.explode(F.arrays_zip("sources", "ns")).alias("x"))
    counted = counted.select("lang", "term", "lang_n", F.col("x.sources").alias("code"), F.col("x.ns").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "code"], "left").join(langs, ["lang"], "left")
    groups = groups.select(
        "lang", "source", "code", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")],
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"),
    )
    groups = written(groups, "groups")
    p, q = (probability(F.col(n), F.col(total), F.col("terms")) for n, total in (("n", "total"), ("lang_n", "lang_total")))
    counted = written(counted.join(groups, ["lang", "code"]).select("lang", "source", "term", "at", p.alias("p"), q.alias("q")), "probabilities")

    told = counted.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    told = told.select("lang", "source", F.lit("term").alias("part"), "item", "value", ranked).where(F.col("rank") <= top)

    sums = pair_values(kept.select("lang", "term"), counted.select("lang", "term", "at", "p"), groups)
    both = sums.union(sums.select("lang", "j", "i", "value")).toDF("_lang", "i", "j", "value")
    one = groups.select("lang", "source", F.col("at").alias("_i"))
    other = groups.select(F.col("lang").alias("_l"), F.col("source").alias("item"), F.col("at").alias("_j"))
    pairs = one.join(other, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item")))
    pairs = pairs.join(both, (F.col("lang") == F.col("_lang")) & (F.col("_i") == F.col("i")) & (F.col("_j") == F.col("j")), "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", ranked).union(told)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), words AS (
  SELECT lang, source, doc, unnest(found) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY ALL
), counted AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counted GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v, coalesce(lang_total, 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)
), probs AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2) // (total + 2 * v) AS p,
         1 + 1000000000 * (lang_n + 2) // (lang_total + 2 * v) AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
), pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), told AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM probs WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM told)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

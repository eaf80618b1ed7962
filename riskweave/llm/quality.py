"""Quality rules: counts and fixed limits, then a trained model's verdict.

The model is a logistic regression on hashed n-grams: words (1 and 2) and characters (2 and 4). A text's feature in a
family is the share of its n-grams that fall in a hashed place, so that a score is a sum of mean weights and needs no
counting table. The steps of the fit end when rows that it doesn't see get no better. Platt's scaling on those rows (on
all, where those are of one kind) makes the score a probability; a text is kept from KEEP_AT upwards. The fit uses up to SAMPLE labelled documents in hash order (an id
counts once, with its row of least hash), of whose texts each is taken that still fits in FIT_BYTES; counts and scores cover
all rows and whole texts, however long.

Nulls: a null text has no words and fails the base rules; rows without a quality label are not learnt from, nor are null
ids, which are scored like others. With no labels of both kinds, the base rules alone decide; of an id's several labels
the greatest counts. Repeated rows get equal values. An empty table gives an empty result; other columns are not read,
and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import BATCH_BYTES, bounded_batches, slices, table
from riskweave.llm.words import Chunk, chunks, grams, mix

SAMPLE = 3000
FIT_BYTES = 16 << 20
PLACES = 1 << 15  # of each family
STEPS, CHECK = 120, 10  # at most; and how many between two looks at the rows that the fit doesn't see
RATE = 1.0
DECAY = 1e-7
MIN_WORDS = 50
KEEP_AT = 0.5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(chunk: Chunk, texts: list[bytes], names: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[chunk.ends] - sums[chunk.begins]

    def per_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[chunk.word_to] - sums[chunk.word_from]

    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    point = ~space
    point[0x80:0xC0] = False  # bytes that continue a code point
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    repeated = np.zeros(len(names), dtype=bool)
    threes = grams(names, 3)
    if len(threes):
        of = chunk.text_of
        at = np.flatnonzero(of[: len(threes)] == of[2:])
        key = mix(threes[at] + (of[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        ordered = key[order]
        same = np.zeros(len(key), dtype=bool)
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= same[1:]
        found = at[order[same]]
        for k in range(3):
            repeated[found + k] = True
    return {
        "n_words": chunk.counts.astype(np.int64),
        "word_chars": per_text(point[chunk.buf]),
        "n_symbols": per_text(_SYMBOL[chunk.buf]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": per_words(repeated),
    }


def families(chunk: Chunk, names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: places of all n-grams in the chunk, and the text of each."""
    out = [((names >> np.uint64(40)).astype(np.int64) % PLACES, chunk.text_of)]
    twos = grams(names, 2)
    inside = np.flatnonzero(chunk.text_of[:-1] == chunk.text_of[1:]) if len(twos) else np.zeros(0, dtype=np.int64)
    out.append(((twos[inside] >> np.uint64(40)).astype(np.int64) % PLACES, chunk.text_of[inside]))
    chars = np.frombuffer(chunk.buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    upto = np.concatenate(([0], np.cumsum((chunk.buf & 0xC0) != 0x80)))  # characters before a byte
    begins = upto[chunk.begins]
    sizes = upto[chunk.ends] - begins - 1
    for n in (2, 4):
        name = np.zeros(max(0, len(chars) - n + 1), dtype=np.uint32)
        for k in range(n):
            name = (name + chars[k : k + len(name)] + np.uint32(1)) * np.uint32(0x9E3779B1)
            name ^= name >> np.uint32(15)
        counts = np.maximum(sizes - n + 1, 0)
        of = np.repeat(np.arange(chunk.n), counts)
        first = np.cumsum(counts) - counts
        at = np.arange(len(of)) - np.repeat(first - begins, counts)
        out.append(((name[at] & np.uint32(PLACES - 1)).astype(np.int64), of))
    return out


def margins(chunk: Chunk, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the families of the mean weight of a text's n-grams."""
    total = np.zeros(chunk.n)
    for k, (place, of) in enumerate(families(chunk, names)):
        sums = np.bincount(of, weights=weights[k][place], minlength=chunk.n)
        total += sums / np.maximum(np.bincount(of, minlength=chunk.n), 1)
    return total


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float, float] | None:
    """Weights, and slope and offset of the calibration; None without rows of both kinds."""
    if len({y for _, y in rows}) < 2:
        return None
    wanted = np.array([y for _, y in rows], dtype=np.float64)
    idx, val, of = [], [], []
    for chunk in chunks([t for t, _ in rows]):
        names = chunk.hashes()
        for k, (place, text) in enumerate(families(chunk, names)):
            key, count = np.unique(text * PLACES + place, return_counts=True)
            all_of = np.bincount(text, minlength=chunk.n)
            idx.append((key % PLACES + k * PLACES).astype(np.int32))
            of.append((key // PLACES + chunk.first).astype(np.int32))
            val.append((count / all_of[key // PLACES]).astype(np.float32))
    idx, val, of = np.concatenate(idx), np.concatenate(val), np.concatenate(of)
    test = np.arange(len(rows)) % 4 == 3
    if len(set(wanted[~test])) < 2:
        test[:] = False
    share = np.where(wanted == 1, 0.5 / max(1, wanted[~test].sum()), 0.5 / max(1, (1 - wanted[~test]).sum())) * ~test
    w, bias = np.zeros(4 * PLACES), 0.0
    m, v = np.zeros(4 * PLACES + 1), np.zeros(4 * PLACES + 1)
    score = np.zeros(len(rows))
    held = test if test.any() else ~test
    least, best = np.inf, (w, score)
    for step in range(1, STEPS + 1):
        error = share * (1 / (1 + np.exp(-np.clip(score + bias, -30, 30))) - wanted)
        slope = np.append(np.bincount(idx, weights=val * error[of], minlength=4 * PLACES) + DECAY * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - change[:-1], bias - 0.1 * change[-1]
        score = np.bincount(of, weights=val * w[idx], minlength=len(rows))
        if step % CHECK == 0:
            said = np.clip(score[held] + bias, -30, 30)
            loss = float(np.mean(np.log1p(np.exp(said)) - wanted[held] * said))
            if loss >= least:
                break
            least, best = loss, (w, score)
    w, score = best
    if len(set(wanted[held])) < 2:  # one kind alone can't calibrate
        held = np.ones(len(rows), dtype=bool)
    return w.reshape(4, PLACES).astype(np.float32), *platt(score[held], wanted[held])


def platt(score: np.ndarray, wanted: np.ndarray) -> tuple[float, float]:
    """Slope and offset with 1 / (1 + exp(-(slope * score + offset))) as probability; by Newton's method on smoothed targets."""
    yes, no = wanted.sum(), (1 - wanted).sum()
    goal = np.where(wanted == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    middle, scale = score.mean(), max(score.std(), 1e-9)
    x = np.stack([(score - middle) / scale, np.ones_like(score)], axis=1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        t -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * t)
    return t[0] / scale, t[1] - t[0] * middle / scale


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """Up to SAMPLE labelled texts of FIT_BYTES in all: the ids of documents that come first in hash order. A text that doesn't fit
    any more is left out, and those after it still count."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels without a document take no place
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # so at most SAMPLE rows are broadcast
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    picked = F.broadcast(picked.select(F.col("doc_id").alias("_id"), "label"))
    narrow = rows.join(picked, F.col("id") == F.col("_id")).select("id", "label", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    narrow = narrow.groupBy("id", "label").agg(F.min(F.struct("hash", "size")).alias("row")).select("id", "label", "row.*")
    chosen, left = [], FIT_BYTES
    for r in sorted(narrow.collect(), key=lambda r: (zlib.crc32(repr(r["id"]).encode()), r["id"])):  # SAMPLE narrow rows at most
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r["id"], r["hash"], r["label"]))
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "_id long, _hash long, label int"))
    got = rows.join(wanted, (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).dropDuplicates(["id"]).collect()
    got = sorted(got, key=lambda r: r["id"])
    order = np.random.default_rng(5).permutation(len(got))
    return [(got[i]["text"], int(got[i]["label"])) for i in order]


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rate(df: DataFrame, key: str, text: str, model: tuple[np.ndarray, float, float] | None) -> DataFrame:
    """key, the counts and the calibrated probability (null without a model) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, BATCH_BYTES)):
            texts = batch.column(1).to_pylist()
            for chunk in chunks(texts):
                names = chunk.hashes()
                raw = chunk.buf.tobytes()
                own = [raw[a : b - 1] for a, b in zip(chunk.begins, chunk.ends, strict=True)]
                counts = base_counts(chunk, own, names)
                if model is None:
                    p = pa.nulls(chunk.n, pa.float64())
                else:
                    p = pa.array(1 / (1 + np.exp(-np.clip(model[1] * margins(chunk, names, model[0]) + model[2], -30, 30))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[chunk.first : chunk.first + chunk.n], *(pa.array(counts[c]) for c in COLUMNS), p],
                    names=[key, *COLUMNS, "quality_p"],
                )

    bounded_batches(df)
    rows = df.select(key, text)
    kinds = ", ".join(f"{c} bigint" for c in COLUMNS)
    return rows.mapInArrow(score, f"`{key}` {rows.schema[key].dataType.simpleString()}, {kinds}, quality_p double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    rated = rate(docs, "doc_id", "text", model)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.coalesce(F.col("quality_p") >= KEEP_AT, F.lit(True))
    return rated.select("doc_id", *COLUMNS, failed.alias("base_failed"), (~failed & good).alias("kept"), F.round("quality_p", 6).alias("quality_p"))

"""Language identification with a blended-spectrum string kernel.

Two texts are as similar as the share of byte n-grams (1 to 4) that both have, whatever their counts:
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), with n-grams hashed to DIM places. Landmark texts span the kernel
(Nystrom): one-versus-rest kernel ridge regression is fitted on k(x, landmarks) of a bounded sample. A batch of texts
is scored as a product of its presence matrix with the landmarks' matrix times the coefficients, (X L') A = X (L' A),
so the second product is done once.

Every language is learnt. The fit uses up to PER_LANG rows of each, taken in hash order, and SAMPLE rows in all: with
more than SAMPLE / PER_LANG languages each gets an equal share, one row at least, and MARKS landmarks as long as these
are MOST_MARKS at most, one at least. All its texts come to FIT_BYTES at most, dealt to the languages alike (one row each
may go beyond). An id counts once, in the rarest of its languages (unless that
leaves another without any row), with its row of least hash. The weights take 4 * DIM bytes a
language; more than MOST_LANGS languages are an error. The scoring covers all rows and whole texts, however long.

Nulls: null text, or one without a letter, is ``und`` with score 0; rows without a language are not learnt from; a null
id is an id like any other. With nothing to learn from, every row is ``und``. Of languages with equal scores the first
by name is told. Repeated rows get equal values. An empty table gives an empty result; other columns are not read, and
may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import BATCH_BYTES, bounded_batches, slices, table

DIM = 1 << 15
ORDERS = (1, 2, 3, 4)
PER_LANG = 400
SAMPLE = 6400
FIT_BYTES = 32 << 20
LANDMARKS = 256
MARKS = 16  # of each language, where there are more than LANDMARKS / MARKS
MOST_MARKS = 1024
RIDGE = 1e-3
ROWS = 64  # texts of a presence matrix
REJECT = 0.1
MOST_LANGS = 512  # as the weights go to every worker
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:97] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[123:128] = 32


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def presence(texts: list[str]) -> np.ndarray:
    """A row of DIM zeros and ones for each text, divided by the root of its number of ones."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    flat = out.reshape(-1)
    begins = np.cumsum(sizes + 4) - sizes - 4
    buf = _FOLD[np.frombuffer(b"    ".join([*parts, b""]), dtype=np.uint8)].astype(np.uint32)
    for row, (begin, size) in enumerate(zip(begins, sizes, strict=True)):  # n-grams go over into the spaces after a text only
        name = np.zeros(size, dtype=np.uint32)
        for k in range(ORDERS[-1]):
            name = (name + buf[begin + k : begin + k + size] + np.uint32(1)) * np.uint32(0x9E3779B1)
            name ^= name >> np.uint32(15)
            flat[row * DIM + (name & np.uint32(DIM - 1)).astype(np.int64)] = 1
    norm = np.sqrt(np.maximum(out.sum(axis=1), 1))
    out /= norm[:, None]
    return out


def batches_of(texts: list[str], size: int = ROWS) -> Iterator[np.ndarray]:
    for a in range(0, len(texts), size):
        yield presence(texts[a : a + size])


def fit(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages, and one column of weights for each: landmarks' presence times ridge coefficients."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return [], np.zeros((DIM, 0), dtype=np.float32)
    by: dict[str, list[str]] = {lang: [t for t, x in rows if x == lang] for lang in langs}
    each = max(1, LANDMARKS // len(langs), min(MARKS, MOST_MARKS // len(langs)))
    marks = np.concatenate(list(batches_of([t for lang in langs for t in by[lang][:each]])))
    inner = (marks @ marks.T).astype(np.float64)
    cross = np.concatenate([x @ marks.T for x in batches_of([t for t, _ in rows])]).astype(np.float64)
    wanted = np.array([[lang == x for x in langs] for _, lang in rows], dtype=np.float64)
    left = cross.T @ cross + RIDGE * len(rows) * (inner + 1e-6 * np.eye(len(inner)))
    return langs, (marks.T @ np.linalg.solve(left, cross.T @ wanted).astype(np.float32)).astype(np.float32)


def training_rows(docs: DataFrame, key: str, text: str, lang: str, learn: Column) -> list[tuple[str, str]]:
    """The bounded sample: ids first, from two narrow columns, then their texts."""
    able = F.col(text).rlike(r"\p{L}")  # as has_letter
    rows = docs.where(learn & F.col(lang).isNotNull() & able).select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = rows.select("id", "lang", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    # Distinct ids, as rows may repeat one very often; an estimate will do, for a threshold with room to spare.
    found = known.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"), F.max(F.col("id").isNull().cast("int")).alias("null_id")).limit(MOST_LANGS + 1).collect()
    if len(found) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: the column holds something else, or needs cleaning first")
    counts = {r["lang"]: r["ids"] + r["null_id"] for r in found}
    each = max(1, min(PER_LANG, SAMPLE // max(1, len(counts))))
    # A hash threshold leaves about four times the rows wanted of each language, so that few rows are ranked at any size;
    # at least 64, so that none loses all its rows.
    order = F.xxhash64("id")
    shares = [(name, min(1.0, max(64, 4 * each) / count), count) for name, count in counts.items()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "_name string, _share double, _ids long"))
    few = known.join(shares, F.col("lang") == F.col("_name")).where(F.shiftrightunsigned(order, 11) < F.col("_share") * float(1 << 53))
    few = few.groupBy("id", "lang", "_ids").agg(F.min(F.struct("hash", "size")).alias("row")).select("id", "lang", "_ids", "row.*")
    # An id of several languages counts in the rarest; a language of such ids alone keeps one.
    few = few.withColumn("_other", F.min(F.struct("_ids", "lang")).over(Window.partitionBy("id"))["lang"] != F.col("lang"))
    by = Window.partitionBy("lang").orderBy("_other", order, "id")
    ranked = few.withColumn("_rank", F.row_number().over(by)).where((F.col("_rank") <= each) & (~F.col("_other") | (F.col("_rank") == 1)))
    ranked = ranked.withColumn("_sum", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    picked = ranked.where((F.col("_rank") == 1) | (F.col("_sum") <= FIT_BYTES // max(1, len(counts)))).select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("hash").alias("_hash"))
    # At most SAMPLE ids, or one a language: safe to broadcast.
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_hash"))
    got = rows.join(F.broadcast(picked), same, "left_semi").dropDuplicates(["id", "lang"]).collect()
    got = [r for r in got if r["lang"] in counts and has_letter(r["text"])]
    return [(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (hash_order(r["id"]), r["lang"], r["text"]))]


def hash_order(key: object) -> int:
    import zlib

    return zlib.crc32(repr(key).encode())


def _told(rows: DataFrame, langs: list[str], weights: np.ndarray) -> DataFrame:
    """lang_pred and score beside the columns of (rest, text); a text goes to Python once."""
    bounded_batches(rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                texts = batch.column(1).to_pylist()
                pred, best = ["und"] * len(texts), np.zeros(len(texts))
                able = [i for i, t in enumerate(texts) if langs and t is not None and has_letter(t)]
                for a in range(0, len(able), ROWS):
                    some = able[a : a + ROWS]
                    values = presence([texts[i] for i in some]) @ weights
                    top = values.argmax(axis=1)
                    for i, j in zip(some, top, strict=True):
                        pred[i] = langs[j]
                    best[some] = np.clip(values[np.arange(len(some)), top], 0, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(best)], names=["rest", "text", "lang_pred", "score"])

    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(score, f"rest {kind}, text string, lang_pred string, score double")


def identify(df: DataFrame, key: str, text: str, langs: list[str], weights: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, lang_pred and score of every row."""
    told = _told(df.select(F.struct(key, *keep).alias("rest"), F.col(text).alias("text")), langs, weights)
    return told.select("rest.*", "lang_pred", "score")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return fit(training_rows(docs, "doc_id", "text", "lang", ~held_out(F.col("doc_id"))))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, weights = trained(docs)
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(rows, "doc_id", "text", langs, weights, keep=("held_out",))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of the documents table whose language is told with a score of REJECT or more.

    If no row has a language to learn from, there is nothing to tell a text by: all rows stay.
    """
    langs, weights = trained(docs)
    if not langs:
        return docs
    others = [c for c in docs.columns if c != "text"]
    told = _told(docs.select(F.struct(*others).alias("rest"), "text"), langs, weights)
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= REJECT))
    return kept.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])

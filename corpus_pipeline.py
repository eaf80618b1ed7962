"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

language       rows without a recognisable language go
near_copies    of each component of the Jaccard join (5-word shingles, 80 %), the document with the smallest id stays
repeats        passages of 13 words and more that an earlier document has are cut out; empty rests go
mixture        sources are repeated to the target weights; every row stays at least once
pieces         two sampled segmentations of each text, with their inclusion scores

Null texts, and texts without letters, go in the first stage, unless no row at all has a language to learn from: then all
rows pass it. Null ids are no near copies of anything and lose nothing to others. Rows that repeat an id count as one
document and go or stay together. Of copies the smallest id stays, of passages the first document's. Long texts are
handled whole in each stage. An empty table gives an empty result. Other columns, whatever their names, go through all
stages but the last, which keeps doc_id, lang and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import jaccard, langid, mixing, pieces, substrings
from riskweave.llm.common import written

NEAR_WORDS, NEAR_SHARE = 5, 80  # of the stage; op3_jaccard has values of its own


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=NEAR_WORDS, share=NEAR_SHARE)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_top_k(docs, "doc_id", "text", keep=("lang", "source")).drop("text")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("mixture", mixture),
    ("pieces", encoded),
]
ORACLE_SQL = None  # the kernel classifier and the sampled segmentations have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Personal-data candidates in a stream of texts, with operators that keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import columns, rules


def stream_candidates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind and masked value of each candidate with right check digits; works on batches and on streams alike."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("values")) for kind, pattern, *_ in rules.CANDIDATES])
    each = rows.select(key, F.explode(kinds).alias("k")).select(key, "k.kind", F.explode("k.values").alias("value"))
    good = each.where(columns.is_valid(F.col("kind"), F.col("value")))
    return good.select(key, "kind", columns.masked(F.col("kind"), F.col("value")).alias("mask"))

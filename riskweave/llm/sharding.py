"""Sharding by jump consistent hashing, in built-in expressions only.

``jump_hash`` is the published jump algorithm with xxhash64(key, step) as its random source (a wrapping 64-bit
product, as in the usual generator, is an overflow error under ANSI arithmetic). A key's shard depends on the key
and the shard count alone; with one more shard, a row either stays or moves into the new one.

Nulls: a null key hashes like a value of its own; a null text has size 8 and the CRC of no bytes. Repeated rows
share a shard and get slots of their own, side by side; they are counted first, so a row that is repeated very often
isn't sorted in one task. A long text only adds to the scan: its size and checksum go on. An empty table gives an empty
result. Columns of the input other than the key and the text are never looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import table

BUCKETS = 4096  # of each shard, for numbering: no task sorts more than one of them at a time
_SHORT = 48  # jumps tried first; about ln(n) are needed


def _jumps(key: Column, n: Column, most: Column) -> Column:
    """The state (b, j) after so many jumps; a state with j >= n stays."""
    state = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, step: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, step), 33) + F.lit(1)
        to = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long")
        return F.when(s["j"] >= n, s).otherwise(F.struct(s["j"].alias("b"), to.alias("j")))

    return F.aggregate(F.sequence(F.lit(1), most), state, jump)


def jump_hash(key: Column, shards: int | Column) -> Column:
    """Shard of ``key`` among ``shards``. Every jump goes up by one at least, so ``shards`` jumps always suffice."""
    n = F.lit(shards).cast("long") if isinstance(shards, int) else shards.cast("long")
    if isinstance(shards, int) and shards <= _SHORT:
        return _jumps(key, n, F.lit(shards))["b"].cast("int")
    short = _jumps(key, n, F.lit(_SHORT))
    return F.when(short["j"] >= n, short["b"]).otherwise(_jumps(key, n, n.cast("int"))["b"]).cast("int")


def assign_shards(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """doc key, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots number a shard's rows without gaps. Rows are spread over BUCKETS of each shard by hash; bucket sizes give
    every bucket its first slot, so that only one bucket's rows are ever sorted together. The table of bucket sizes
    has shards * BUCKETS rows at most, whatever the input. Only keys, sizes and checksums are shuffled, no texts.
    """
    rows = df.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    ).withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), "text_crc32", "size"), F.lit(BUCKETS)))
    units = rows.groupBy("shard", "grown_shard", "_bucket", key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = units.groupBy("shard", "_bucket").agg(F.sum("_rows").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(key, "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_rows").over(within), F.lit(0))
    placed = units.join(starts, ["shard", "_bucket"]).withColumn("_first", first)
    return placed.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("_first", F.col("_first") + F.col("_rows") - 1)).alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write whole rows into one folder per shard; each shard's rows may come from several tasks."""
    out = df.withColumn("shard", jump_hash(F.col(key), shards))
    parts = F.pmod(F.xxhash64(F.col(key), F.lit("file")), F.lit(8))
    out.repartition("shard", parts).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", 24)

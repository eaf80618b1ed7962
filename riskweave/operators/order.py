"""Places in a total order of very many rows, without a task that sees them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("entrypoint", "operation", "tool", "external_call")


def _stable(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint: ranges are drawn by sampling, so they must not be drawn twice, nor rows made twice."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Adds ``into``: 1, 2, ... in ascending order of the columns. Rows are dealt by ranges of the order and numbered within
    their range; a range begins where those before it end. Only the ranges' sizes, a row each, are summed in one task and broadcast.
    Drawing the ranges reads all rows before they are dealt, so what makes them is run once and kept."""
    dealt = _stable(_stable(df).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn("_place", place).join(F.broadcast(begins), F.col("_range") == F.col("_of"))
    return out.select(*df.columns, (F.col("_begin") + F.col("_place")).cast("long").alias(into))


def canonical(python: DataFrame, javascript: DataFrame) -> DataFrame:
    """place, lang and the facts' columns in canonical order: Python before JavaScript, by path, by class of fact, then as they
    stand in the file. Facts of one place go by kind, name and provider."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("fact")).cast("int")
    every = python.withColumn("lang", F.lit("python")).unionByName(javascript.withColumn("lang", F.lit("javascript")))
    every = every.withColumns({"_lang": (F.col("lang") == "javascript").cast("int"), "_class": rank})
    out = numbered(every, ["_lang", "path", "_class", "at", "kind", "name", "provider"], "place")
    return out.drop("_lang", "_class")

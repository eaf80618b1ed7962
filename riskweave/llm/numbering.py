"""Places of rows within their group, also where one group holds most rows or one value of the order repeats very often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import written


def numbered(df: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """``df`` with ``into``: 0, 1, ... within each group, in ascending order (nulls first), without gaps; rows that tie in the
    whole order get places side by side.

    Rows are dealt by ranges of group and order (and, last, of their number, so that ties can be split), so a large group
    goes on over several partitions. Rows are numbered within a group's part of a partition, and a part begins where the
    parts before it end. Only a partition's first group can have begun earlier, so these beginnings are at most one row
    a partition: that is the size of what is broadcast. ``df`` goes through the shared folder once.
    """
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_tie")
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("_begin", F.sum("_n").over(before)).where("_begin IS NOT NULL")
    begins = begins.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_range").alias("_of_range"), "_begin")
    place = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    same = F.col("_range") == F.col("_of_range")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = dealt.withColumn("_place", place).join(F.broadcast(begins), same, "left")
    return out.select(*df.columns, (F.coalesce("_begin", F.lit(0)) + F.col("_place")).cast("long").alias(into))

"""Connected components by alternating stars, as joins and groupings of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import written


def _canonical(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every larger node has one edge and no least node is a larger one of another."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """doc and component (its least member) for every id that has an edge, the least ones included.

    Each round hangs every node's larger neighbours on its least one, then every node and its smaller neighbours on
    the least of those; the rounds needed grow with the logarithm of a component's size. A node's minimum is
    pre-aggregated, and joined back with a join that Spark may split, so a node with very many edges is no single
    task's work. Each round is a table in the shared folder.
    """
    held = written(_canonical(edges, a, b), "edges")
    while not _stars_only(held):
        both = held.union(held.select("v", "u")).toDF("n", "near")
        # As a table, so that the join below deals both sides out anew and may split a node with very many edges.
        least = written(both.groupBy("n").agg(F.least(F.min("near"), F.col("n")).alias("m")).withColumnRenamed("n", "k"), "least")
        large = both.where("near > n").join(least, F.col("n") == F.col("k")).select(F.col("near").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large-stars")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        held = written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
    members = held.select(F.col("u").alias("doc"), F.col("v").alias("component"))
    return members.union(held.select("v", "v").distinct()).toDF("doc", "component")

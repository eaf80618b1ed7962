"""Mixing sources to target weights, in built-in expressions only.

A source with a share p of all tokens gets a weight proportional to p**a. The exponent a in [0, 1] is bisected so
that the mixture meets a target entropy (a share of the largest possible one), or so that no source is repeated
more than a limit; at a = 1 the mixture is the corpus itself. The token budget is the least with which no document
is left out, or a given number. Each source's budget is realised as whole passes and one partial pass, each pass a
new pseudo-random permutation, laid out over blocks that all hold the sources in the target weights; the rows of a
block are permuted once more.

Nulls: rows without a source form a source of their own; a null or empty text counts as one token, so that every
row has a place. Repeated rows (the same id and source) move together and are all kept. An empty table gives an
empty result. Only the id, source and text columns are read here, and those of a clashing name stay as they are. A long
text is one unit like any other; of units with equal places in a permutation, the smaller id comes first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import count_words, table, written

BUCKETS = 1024  # of each pass over a source, in the order of its permutation
MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 18
SEED = 17
_LEVELS = 6  # bisections whose outcomes one job prepares


def unit_tokens(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row for each id and source: how many tokens its rows hold."""
    tokens = F.greatest(count_words(F.col(text)), F.lit(1))
    return (
        docs.select(F.col(key).alias("id"), F.col(source).alias("source"), tokens.alias("n"))
        .groupBy("id", "source")
        .agg(F.sum("n").alias("n"))
    )


def bisect_exponent(sources: DataFrame, max_repeats: float | None, target_entropy: float | None) -> float:
    """The exponent at which the target is just met, to 2**-30.

    ``sources`` has one row a source, with its ``share``. A job evaluates all exponents that the next six bisections
    may ask for, so that five jobs suffice; each returns one row for each exponent and no source is collected.
    """
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("top")).first()
    if not row["n"] or row["n"] == 1:
        return 1.0
    low, high = 0.0, 1.0  # the entropy falls from low to high, and so do the repeats

    def evaluate(grid: list[float]) -> list[tuple[float, float]]:
        power = F.pow("share", "a")
        rows = sources.select("share", F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a"))
        sums = rows.groupBy("i").agg(F.sum(power).alias("z"), F.sum(power * F.log("share") * F.col("a")).alias("l"), F.max(power / F.col("share")).alias("r"))
        got = sorted(sums.collect())  # one row an exponent
        top = row["top"]
        # Repeats count against the largest source, of which one pass is made.
        return [(math.log(x["z"]) - x["l"] / x["z"], x["r"] * top ** (1 - a)) for x, a in zip(got, grid, strict=True)]

    def meets(entropy: float, repeats: float) -> bool:
        """Whether a smaller exponent is allowed still."""
        if max_repeats is not None:
            return repeats <= max_repeats
        return entropy >= target_entropy * math.log(row["n"])

    for _ in range(5):
        steps = 1 << _LEVELS
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        values = evaluate(grid)
        i, j = 0, steps
        while j - i > 1:
            mid = (i + j) // 2
            ok = meets(*values[mid])
            if max_repeats is not None:
                i, j = (i, mid) if ok else (mid, j)
            else:
                i, j = (mid, j) if ok else (i, mid)
        low, high = grid[i], grid[j]
    return high if max_repeats is not None else low


def source_weights(
    units: DataFrame,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
    budget: int | None = None,
) -> DataFrame:
    """source, tokens, weight, goal (its tokens in the mixture); one row a source."""
    tokens = units.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("units"))
    tokens = written(tokens, "mixing-sources")
    total = tokens.agg(F.sum("tokens")).first()[0]
    if not total:
        return tokens.select("source", "tokens", F.lit(1.0).alias("weight"), F.col("tokens").alias("goal"))
    shares = tokens.withColumn("share", F.col("tokens") / F.lit(float(total)))
    a = bisect_exponent(shares, max_repeats, target_entropy)
    power = F.pow("share", F.lit(a))
    z, least = shares.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    size = float(budget) if budget is not None else least * z
    weight = power / F.lit(z)
    goal = F.round(weight * F.lit(size)).cast("long")
    if budget is None:
        goal = F.greatest(goal, F.col("tokens"))
    return shares.select("source", "tokens", weight.alias("weight"), goal.alias("goal"))


def mix(units: DataFrame, weights: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """id, source, n, weight, epoch, block, slot: each place of the mixture that a unit takes.

    A unit is in a pass if the tokens before it, in the pass's permutation, are under the pass's budget. Those sums
    come from BUCKETS ranges of the permutation: sums by bucket first, then within a bucket, so that a source with a
    third of all rows is spread over as many tasks as a corpus needs.
    """
    size = weights.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_tokens))
    # The table of sources is as large as their number; Spark broadcasts it or not by its own threshold.
    same = units["source"].eqNullSafe(weights["source"])
    passes = F.ceil(F.col("goal") / F.col("tokens")).cast("int")
    copies = (
        units.join(weights, same, "inner")
        .select("id", units["source"].alias("source"), "n", "weight", "goal", "tokens", F.explode(F.sequence(F.lit(0), passes - 1)).alias("epoch"))
    )
    order = F.xxhash64(F.lit(seed), "epoch", "id")
    copies = copies.withColumn("_order", order).withColumn("_bucket", F.shiftrightunsigned(F.col("_order").bitwiseXOR(F.lit(-(2**63))), 54))
    keys = ["source", "epoch", "_bucket"]
    sums = copies.groupBy(*keys).agg(F.sum("n").alias("_sum"))
    before = Window.partitionBy("source", "epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    starts = starts.select(*[F.col(k).alias(f"s_{k}") for k in keys], "_start")
    joined = copies.join(
        starts,
        copies["source"].eqNullSafe(starts["s_source"])
        & (copies["epoch"] == starts["s_epoch"])
        & (copies["_bucket"] == starts["s__bucket"]),
    )
    inside = Window.partitionBy(*keys).orderBy("_order", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("epoch") * F.col("tokens") + F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = joined.select("id", "source", "n", "weight", "goal", "epoch", at.alias("_at")).where("_at < goal")
    block = F.least(F.floor(F.col("_at") / F.col("goal") * blocks), F.lit(blocks - 1)).cast("int")
    placed = placed.withColumn("block", block)
    row = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "epoch", "id", "source"), "id", "source")
    return placed.select("id", "source", "n", "weight", "epoch", "block", F.row_number().over(row).alias("slot"))


def mixture(docs: DataFrame, **limits: object) -> DataFrame:
    """Plan of the whole mixture for a table with doc_id, source and text."""
    units = written(unit_tokens(docs), "mixing-units")
    return mix(units, source_weights(units, **limits))


def mixed_documents(docs: DataFrame, **limits: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it."""
    times = mixture(docs, **limits).groupBy("id", "source").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    times = times.select(F.col("id").alias("_id"), F.col("source").alias("_source"), "_times")
    same = docs["doc_id"].eqNullSafe(times["_id"]) & docs["source"].eqNullSafe(times["_source"])
    row = F.struct(*[docs[c].alias(c) for c in docs.columns])
    return docs.join(times, same).select(row.alias("row"), F.explode(F.sequence(F.lit(1), times["_times"])).alias("copy")).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), F.round("weight", 9).alias("weight"), "epoch", "block", "slot"
    )

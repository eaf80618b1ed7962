"""Quotation linking: reply-ordered conversations without quotes, in built-in expressions only.

Lines that begin with one or more ``>`` are quoted, as deep as there are such marks. A passage is a run of quoted
lines of one depth; passages and their lines are normalised (lower case, single spaces) and hashed. The index holds
the hashes of what messages say themselves, whole and by line, each with the first turn of its conversation that says
it. A message answers the earlier turn to which most of its depth-1 passages and lines lead (a whole passage counts
more than its lines; of equals, the later turn). A passage of depth d names an ancestor d levels up: where no shallower
one leads anywhere, the message hangs on that ancestor, the nearest one that its quotes name. Roots of the reply trees come from pointer doubling, so the rounds
grow with the logarithm of a chain's length. A conversation is ordered by the root's turn, then by turn: every reply
comes after what it answers.

Places are dealt out by ranges (``numbering.py``), so a conversation that holds a third of all rows is spread over many tasks, also
if it is one thread, or rows of one turn or of none. The index is pre-aggregated, and all joins are on unique right sides.

Nulls: rows without a conversation or turn link with nothing; a null text is quoted by none and stays null. Rows that
repeat a turn share its link and have places side by side, in order of role and text hash. Of turns with equally many
votes the later one is answered. Quotes of the message itself or of later turns lead nowhere. A long text is split in
lines as a whole. An empty table gives an empty result; columns other than the four are not read, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import table, written
from riskweave.llm.numbering import numbered

_MARKS = r"^((?:[ \t]{0,3}>)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_lines(text: Column) -> Column:
    """Array of (depth, body) of a text's lines."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    marks = lambda line: F.regexp_extract(line, _MARKS, 1)
    return F.transform(
        lines,
        lambda line: F.struct(
            F.length(F.regexp_replace(marks(line), "[^>]", "")).alias("depth"),
            F.when(marks(line) != "", F.regexp_replace(line, _MARKS + " ?", "")).otherwise(line).alias("body"),
        ),
    )


def _runs(messages: DataFrame) -> DataFrame:
    """One row for each run of lines of one depth: conv_id, turn, depth, hash, lines (hashes of the single lines)."""
    lines = messages.select("_row", "conv_id", "turn", F.posexplode("lines").alias("at", "line")).select("_row", "conv_id", "turn", "at", "line.depth", "line.body")
    by = Window.partitionBy("_row").orderBy("at")
    new = F.when(F.lag("depth").over(by).eqNullSafe(F.col("depth")), 0).otherwise(1)
    numbered = lines.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by))
    filled = numbered.where(normalised(F.col("body")) != "")
    grouped = filled.groupBy("_row", "conv_id", "turn", "depth", "_run").agg(F.array_sort(F.collect_list(F.struct("at", normalised(F.col("body")).alias("body")))).alias("own"))
    bodies = F.transform("own", lambda x: x["body"])
    return grouped.select("conv_id", "turn", "depth", F.xxhash64(F.array_join(bodies, " ")).alias("hash"), F.transform(bodies, lambda x: F.xxhash64(x)).alias("lines"))


def reply_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the earlier turn that a message answers."""
    able = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    rows = able.select("conv_id", "turn", quote_lines(F.col("text")).alias("lines"))
    quoting = rows.where(F.exists("lines", lambda x: x["depth"] > 0)).withColumn("_row", F.struct("conv_id", "turn", F.xxhash64("lines")))
    quoting = quoting.dropDuplicates(["_row"])
    runs = _runs(quoting).where("depth > 0")
    single = runs.select("conv_id", "turn", "depth", F.explode("lines").alias("hash"), F.lit(1).alias("weight"))
    asked = runs.select("conv_id", "turn", "depth", "hash", (F.size("lines") + 1).alias("weight")).union(single)
    own = F.filter("lines", lambda x: (x["depth"] == 0) & (normalised(x["body"]) != ""))
    said = rows.select("conv_id", "turn", F.transform(own, lambda x: normalised(x["body"])).alias("own")).where(F.size("own") > 0)
    hashes = F.array_union(F.array(F.xxhash64(F.array_join("own", " "))), F.transform("own", lambda x: F.xxhash64(x)))
    index = said.select("conv_id", "turn", F.explode(hashes).alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("parent"))
    index = index.select(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash"), "parent")
    led = asked.join(index, (F.col("conv_id") == F.col("_conv")) & (F.col("hash") == F.col("_hash"))).where("parent < turn")
    votes = led.groupBy("conv_id", "turn", "depth", "parent").agg(F.sum("weight").alias("votes"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("parent", F.struct(-F.col("depth"), "votes", "parent")).alias("parent"))


def roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root and depth of every message that answers another."""
    held = written(links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), "replies")
    while True:
        up = held.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        same = (F.col("conv_id") == F.col("_conv")) & (F.col("root") == F.col("_turn"))
        joined = held.join(up, same, "left")
        if joined.where("_root IS NOT NULL").isEmpty():
            return held
        held = written(
            joined.select("conv_id", "turn", "parent", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")),
            "replies",
        )


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, depth, quote_depth, position and text without quotes, for every row."""
    tree = roots(reply_links(messages)).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent", "root", "depth")
    rows = messages.select("conv_id", "turn", "role", "text")
    lines = quote_lines(F.col("text"))
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["depth"] == 0), lambda x: x["body"]), "\n")
    quoted = F.col("text").rlike(r"(?m)" + _MARKS)
    rows = rows.withColumn("quote_depth", F.when(quoted, F.array_max(F.transform(lines, lambda x: x["depth"]))).otherwise(0))
    rows = rows.withColumn("text", F.when(quoted, F.trim(kept)).otherwise(F.col("text")))
    joined = rows.join(tree, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    placed = joined.select(
        "conv_id", "turn", "role", "text", F.col("parent").alias("reply_to"), F.coalesce("root", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "quote_depth", F.xxhash64("text").alias("_hash"),
    )
    placed = numbered(placed, ["conv_id"], ["thread", "turn", "role", "_hash"], "position")
    return placed.select("conv_id", "turn", "role", "reply_to", "thread", "depth", "quote_depth", "position", "text")


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))

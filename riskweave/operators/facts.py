"""Facts of JavaScript, configuration and manifest files, by pattern alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import rules
from riskweave.functions.columns import bound
from riskweave.operators.matches import all_found, found_in

FACT = "path string, fact string, kind string, name string, provider string, model string, line int, at long, snippet string, enclosing string, prev_comment string, return_var string, url string, parameters array<string>"


def js_files(files: DataFrame) -> DataFrame:
    suffix = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    return files.where(suffix.isin(*rules.JS_SUFFIXES) & ~F.arrays_overlap("parts", F.lit(list(rules.JS_IGNORED))))


def js_provider(text: Column) -> Column:
    """The model provider whose package a file imports; the first of the list wins."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules.JS_PROVIDERS):
        out = F.when(text.rlike("(?U)" + pattern), name).otherwise(out)
    return out


def js_matches(files: DataFrame) -> DataFrame:
    """Handlers, routes, model calls and tools with their line, the last line above it that isn't empty and, for each,
    the last function declared before it (an as-of join).

    Lines are taken within the file's row. Declarations and matches are narrow rows of one frame, in order of their
    offset, so the join is a running last value.
    """
    u = "(?U)"
    patterns = [
        ("nextjs_route", u + rules.JS_HANDLER, 1), ("express_route", u + rules.JS_ROUTE, 2), ("call", u + rules.JS_CALL, 1),
        ("tool", u + rules.JS_TOOL, 0), ("function", u + rules.JS_FUNCTION, 3),
    ]
    last = lambda lines: f"try_element_at(filter({lines}, l -> l != ''), -1)"
    # The last 16 lines first: seldom is the line above empty so often.
    above = f"CASE WHEN m.kind = 'call' AND m.line > 1 THEN coalesce({last('slice(ls, greatest(1, m.line - 16), least(m.line - 1, 16))')}, {last('slice(ls, 1, m.line - 1)')}) END"
    row = f"named_struct('m', m, 'own', CASE WHEN m.kind != 'function' THEN get(ls, m.line - 1) END, 'above', {above})"
    found = all_found([found_in("text", *p) for p in patterns])
    placed = bound("split(text, '\\n', -1)", "ls", f"transform({found}, m -> {row})")
    rows = files.select("path", js_provider(F.col("text")).alias("hint"), F.explode(F.expr(placed)).alias("x"))
    rows = rows.select("path", "hint", "x.m.*", F.col("x.own").alias("own"), F.col("x.above").alias("above"))
    names = F.when(F.col("kind") == "function", F.element_at(F.filter("groups", lambda g: F.coalesce(g, F.lit("")) != ""), 1))
    # A declaration counts once it has ended before the match begins.
    order = F.when(F.col("kind") == "function", F.col("at") + F.length("value") - 0.5).otherwise(F.col("at"))
    before = Window.partitionBy("path").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"_name": names, "_order": order})
    return placed.withColumn("enclosing", F.last("_name", ignorenulls=True).over(before)).where("kind != 'function'").drop("_name", "_order")


def js_facts(files: DataFrame) -> DataFrame:
    """Rows of FACT for JavaScript and TypeScript files."""
    rows = js_matches(js_files(files))
    kind, group = F.col("kind"), lambda n: F.get("groups", F.lit(n))
    is_call = kind == "call"
    rows = rows.withColumn("c", F.trim("above"))
    text = F.trim(F.regexp_replace("c", "^/+", ""))
    return rows.select(
        "path",
        F.when(kind.isin("nextjs_route", "express_route"), "entrypoint").when(is_call, "operation").otherwise("tool").alias("fact"),
        F.when(is_call, F.when(F.lower(group(0)).contains("embed"), "embed").otherwise("invoke_llm")).otherwise(kind).alias("kind"),
        F.when(kind == "nextjs_route", group(0)).when(kind == "express_route", group(1)).when(kind == "tool", "tool(...)").alias("name"),
        F.when(is_call, F.col("hint")).alias("provider"),
        F.lit(None).cast("string").alias("model"),
        "line",
        F.col("at").cast("long").alias("at"),
        F.when(is_call, F.trim("own")).alias("snippet"),
        F.when(is_call, F.col("enclosing")).alias("enclosing"),
        F.when(is_call & F.col("c").startswith("//") & (text != ""), text).alias("prev_comment"),
        F.lit(None).cast("string").alias("return_var"),
        F.lit(None).cast("string").alias("url"),
        F.array().cast("array<string>").alias("parameters"),
    )


def frameworks(files: DataFrame) -> DataFrame:
    """One row: framework and confidence. ``setup.py`` counts twice, as it matches two of the file patterns."""
    m = "(?Ud)(?m)"
    scanned = files.where(~F.array_contains("parts", ".git"))
    python = scanned.where(F.col("name").endswith(".py"))
    other = scanned.where((F.col("name").isin("pyproject.toml", "setup.py", "Pipfile")) | F.col("name").rlike(r"^requirements.*\.txt$"))
    rows = python.union(other)
    hits = {k: reduce(lambda a, b: a + b, [F.regexp_count("text", F.lit(m + p)) for p in ps]) for k, ps in rules.FRAMEWORKS.items()}
    total = rows.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in hits.items()])
    n = reduce(lambda a, b: a + b, [F.col(k) for k in hits])
    top = F.greatest(*[F.col(k) for k in hits])
    best = F.lit("unknown")
    for k in reversed(list(hits)):
        best = F.when(F.col(k) == top, k).otherwise(best)
    share = top / n
    for k in reversed(rules.FRAMEWORKS_FIRST):
        best = F.when(F.col(k) > 0, k).otherwise(best)
        share = F.when(F.col(k) > 0, F.least(F.lit(1.0), F.col(k) / n + 0.25)).otherwise(share)
    return total.select(F.when(n > 0, best).otherwise("unknown").alias("framework"), F.when(n > 0, share).otherwise(0.0).alias("confidence"))


def config_facts(files: DataFrame) -> DataFrame:
    """path, fact (file, provider, base_url, retention), name, value of configuration files in any folder."""
    some = files.where(F.col("name").isin(*rules.CONFIG_NAMES))
    m = "(?Ud)(?m)"
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all("text", F.lit(m + p), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(m + p), F.lit(2)).alias("value"))
    bare = F.regexp_replace("x.value", "^[\"']+|[\"']+$", "")

    def listed(fact: str, pattern: str) -> DataFrame:
        return some.select("path", F.explode(pairs(pattern)).alias("x")).select("path", F.lit(fact).alias("fact"), F.col("x").getField("name").alias("name"), bare.alias("value"))

    none = F.lit(None).cast("string")
    seen = some.select("path", F.lit("file").alias("fact"), F.col("path").alias("name"), none.alias("value"))
    declared = F.array_compact(F.array(*[F.when(F.col("text").rlike(m + p), k) for k, p in rules.PROVIDER_KEYS]))
    providers = some.select("path", F.lit("provider").alias("fact"), F.explode(declared).alias("name"), none.alias("value"))
    return seen.union(providers).union(listed("base_url", rules.BASE_URL)).union(listed("retention", rules.RETENTION))


def providers_declared(config: DataFrame) -> DataFrame:
    """name and place of each provider that configuration declares, once, in order of the first file that does."""
    order = {k: n for n, (k, _) in enumerate(rules.PROVIDER_KEYS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("name")]
    firsts = config.where("fact = 'provider'").groupBy("name").agg(F.min(F.struct("path", rank.alias("rank"))).alias("first"))
    by = Window.orderBy("first")  # as many rows as there are providers
    return firsts.select("name", F.row_number().over(by).alias("place"))


def operation_share(operations: DataFrame, provider: str = "provider") -> DataFrame:
    """provider and its share of the operations that have one."""
    counts = operations.where(F.coalesce(F.col(provider), F.lit("")) != "").groupBy(provider).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(F.col(provider), (F.col("n") / F.col("total")).alias("share"))

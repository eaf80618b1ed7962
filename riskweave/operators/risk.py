"""Risks: facts joined with the catalog, inherent and residual scores, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import columns, rules

EVIDENCE = "array<struct<file: string, line: int, kind: string>>"


#: Flags in the order in which their evidence is listed, after that of kinds.
FLAG_ORDER = {"pii": 1, "external_provider": 2, "telemetry": 3, "memory_store": 4, "vector_store": 5}


def trigger_places(operations: DataFrame, findings: DataFrame) -> DataFrame:
    """path, line, kind and triggers: each place once, with all that it triggers (``kind:`` and an operation's kind, or
    a flag). The operations and the findings are read once."""
    kind = F.col("kind")
    flags = {
        "external_provider": F.coalesce(F.col("provider"), F.lit("")) != "",
        "telemetry": kind == "telemetry",
        "memory_store": kind == "memory_persist",
        "vector_store": kind.isin(*rules.VECTOR_KINDS),
    }
    said = F.array_compact(F.array(F.concat(F.lit("kind:"), kind), *[F.when(test, name) for name, test in flags.items()]))
    ops = operations.select("path", "line", "kind", said.alias("triggers"))
    high = findings.where(F.coalesce("tier", F.lit("high")) == "high")
    pii = high.select("path", "line", F.concat(F.lit("pii:"), "kind").alias("kind"), F.array(F.lit("pii")).alias("triggers"))
    places = ops.unionByName(pii).where(F.size("triggers") > 0).groupBy("path", "line", "kind")
    return places.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("triggers")))).alias("triggers"))


def rule_triggers(catalog: DataFrame) -> DataFrame:
    """id, trigger and branch (the order of its evidence) of each rule; as small as the catalog."""
    kinds = F.transform(F.coalesce("operations", F.array().cast("array<string>")), lambda k: F.struct(F.concat(F.lit("kind:"), k).alias("trigger"), F.lit(0).alias("branch")))
    order = F.create_map(*[F.lit(x) for pair in FLAG_ORDER.items() for x in pair])
    flags = F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: f.isin(*FLAG_ORDER))
    flags = F.transform(flags, lambda f: F.struct(f.alias("trigger"), F.get(F.array(order[f]), F.lit(0)).alias("branch")))
    return catalog.select("id", F.explode(F.concat(kinds, flags)).alias("t")).select("id", "t.trigger", "t.branch")


def scored(risks: DataFrame) -> DataFrame:
    """Adds inherent and residual probability, impact and level, the treatment, and whether the risk applies always."""
    p, i = columns.clamped(F.col("p")), columns.clamped(F.col("i"))
    cut = lambda name: F.aggregate("mitigacoes", F.lit(0), lambda a, m: a + m[name])
    left_p, left_i = columns.residual(p, i, cut("probability"), cut("impact"))
    level = columns.level(left_p, left_i)
    return risks.select(
        "ord", "id", "categoria", "descricao", "artigos", p.alias("probabilidade_inerente"), i.alias("impacto_inerente"), columns.level(p, i).alias("nivel_inerente"),
        left_p.alias("probabilidade_residual"), left_i.alias("impacto_residual"), level.alias("nivel_residual"), columns.treatment(level).alias("tratamento"),
        F.transform("mitigacoes", lambda m: m["text"]).alias("mitigacoes"), F.coalesce(F.array_contains("flags", "always"), F.lit(False)).alias("always"),
    )


def evidence_rows(catalog: DataFrame, operations: DataFrame, findings: DataFrame) -> DataFrame:
    """id, branch, path, line and kind: each place of each risk once, with the first of the branches that lead to it."""
    each = trigger_places(operations, findings).select("path", "line", "kind", F.explode("triggers").alias("trigger"))
    met = each.join(F.broadcast(rule_triggers(catalog)), "trigger")  # the rules are few: a fixed, small table
    return met.groupBy("id", "path", "line", "kind").agg(F.min("branch").alias("branch"))


def evidence(catalog: DataFrame, operations: DataFrame, findings: DataFrame) -> DataFrame:
    """id and evidencia, all places of a risk in one array: for the report of one repository only."""
    listed = F.array_sort(F.collect_list(F.struct("branch", "path", "line", "kind")))
    plain = F.transform(listed, lambda x: F.struct(x["path"].alias("file"), x["line"].alias("line"), x["kind"].alias("kind")))
    return evidence_rows(catalog, operations, findings).groupBy("id").agg(plain.alias("evidencia"))


def register(catalog: DataFrame, operations: DataFrame, findings: DataFrame) -> DataFrame:
    """The scored risks of a scan, with the number of places of their evidence and the first one, in catalog order.

    A risk applies always, by an operation's kind or by a flag. Places are counted by the set of things they trigger,
    of which there are few, whatever the scan's size; only those counts meet the catalog. Neither is shuffled or joined
    row by row with the places.
    """
    least = F.min(F.struct("path", "line", "kind")).alias("least")
    profile = trigger_places(operations, findings).groupBy("triggers").agg(F.count(F.lit(1)).alias("n"), least)
    each = profile.select(F.explode("triggers").alias("trigger"), "triggers", "n", "least")
    # A rule that meets a profile by several triggers counts its places once, at the first branch.
    met = each.join(F.broadcast(rule_triggers(catalog)), "trigger").groupBy("id", "triggers").agg(F.first("n").alias("n"), F.min(F.struct("branch", "least")).alias("first"))
    places = met.groupBy("id").agg(F.sum("n").alias("places"), F.min("first").alias("_first"))
    rows = scored(catalog).join(F.broadcast(places), "id", "left")  # a row a risk
    found = F.struct(F.col("_first.least.path").alias("file"), F.col("_first.least.line").alias("line"), F.col("_first.least.kind").alias("kind"))
    rows = rows.where("places > 0 OR always").withColumn("first_place", F.when(F.col("_first").isNotNull(), found)).drop("_first", "always")
    return rows.withColumn("places", F.coalesce("places", F.lit(0)).cast("long")).orderBy("ord")


def with_evidence(register: DataFrame, catalog: DataFrame, operations: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds ``evidencia``, the arrays of all places: for the report of one repository only."""
    rows = register.join(evidence(catalog, operations, findings), "id", "left")
    return rows.withColumn("evidencia", F.coalesce("evidencia", F.array().cast(EVIDENCE))).orderBy("ord")


def histogram(risks: DataFrame, level: str = "nivel_inerente") -> DataFrame:
    """level, n for all four levels, zeros included."""
    levels = risks.sparkSession.createDataFrame([(x, n) for n, x in enumerate(rules.LEVELS)], "level string, ordinal int")
    counts = risks.groupBy(F.col(level).alias("_level")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, F.col("level") == F.col("_level"), "left").select("level", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))


def verdict(risks: DataFrame, threshold: str | None) -> DataFrame:
    """One row: total, worst level, threshold, breached, exit_code (4 if breached)."""
    limit = F.lit(rules.LEVELS.index(threshold) if threshold else None).cast("int")
    top = F.max(F.when(F.col("n") > 0, F.col("ordinal")))
    breached = F.coalesce(top >= limit, F.lit(False))
    row = histogram(risks).agg(
        F.sum("n").alias("total"),
        F.max_by("level", F.when(F.col("n") > 0, F.col("ordinal"))).alias("worst"),
        breached.alias("breached"),
        top.alias("_top"),
    )
    worst = F.when(F.col("_top").isNotNull(), F.col("worst"))
    return row.select("total", worst.alias("worst"), F.lit(threshold).cast("string").alias("threshold"), "breached", F.when(F.col("breached"), 4).otherwise(0).alias("exit_code"))


def residual_summary(risks: DataFrame) -> DataFrame:
    return risks.groupBy("nivel_residual").agg(F.count(F.lit(1)).alias("n"))


def emptiness(facts: DataFrame, confidence: float) -> DataFrame:
    """One row, ``empty``: no framework is likely, and there is neither an operation nor an entrypoint."""
    some = facts.where(F.col("fact").isin("operation", "entrypoint")).select(F.lit(1).alias("x")).limit(1)
    return some.agg((F.count(F.lit(1)) == 0).alias("_none")).select((F.col("_none") & F.lit(confidence < 0.3)).alias("empty"))


def is_empty_scan(facts: DataFrame, confidence: float) -> bool:
    return bool(emptiness(facts, confidence).first()["empty"])

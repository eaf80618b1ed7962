"""Registered queries of the library and their SQL.

The given tables hold no source trees, so some queries derive one from orders, customers or events, row by row: the
same SQL text builds it in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions import columns, urls
from riskweave.functions.catalog import ROWS, risk_catalog
from riskweave.operators import facts, order, pii, risk
from riskweave.operators.python_facts import python_facts, python_files
from riskweave.plans import derived as sources
from riskweave.plans import scan
from riskweave.plans.derived import ADDRESSES, FILES, JS, KINDS, MANIFESTS, NUMBERS, OPERATIONS, PY, THRESHOLDS

def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows that the SQL makes of a table. A row of a few bytes becomes a text that takes many times the work to scan, so the
    narrow rows are dealt out evenly first: few row groups may hold very many of them."""
    parts = 2 * spark.sparkContext.defaultParallelism
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(parts) for t in sources.TABLES if f"FROM {t}" in sql}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        sql = sql.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(sql, **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.split("path", "/").alias("parts"), "text")


def numbers_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, NUMBERS)
    return rows.select(
        "k", columns.is_cpf(F.col("v11")).alias("cpf"), columns.is_cnh(F.col("v11")).alias("cnh"), columns.is_pis(F.col("v11")).alias("pis"),
        columns.is_cnpj(F.col("v14")).alias("cnpj"), columns.is_titulo_eleitor(F.col("v12")).alias("titulo"),
    )


def masked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, NUMBERS)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in (("cpf", F.col("v11")), ("cnpj", F.col("v14")), ("cnh", F.col("v11")), ("titulo_eleitor", F.col("v12")), ("email", F.col("v11")))])
    return rows.select("k", F.explode(kinds).alias("x")).select("k", "x.kind", columns.masked(F.col("x.kind"), F.col("x.v")).alias("mask"))


def documents_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and phone candidates of all documents, with their lines."""
    found = pii.candidate_matches(table(spark, sf_dir, "documents"), ["doc_id"], "text", ("email", "phone"))
    return found.select("doc_id", "kind", "seq", "value", F.col("line").cast("long").alias("line"))


def pages_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.candidate_matches(table(spark, sf_dir, "pages"), ["page_id"], "html", ("email", "phone", "cep"))
    return found.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))


def path_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, FILES).select(F.substring_index("path", "#", 1).alias("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", "n", columns.is_test_path(F.col("path")).alias("test"), columns.is_meta_path(F.col("path")).alias("meta"))


def context_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPF and e-mail candidates of derived files with tier and signals, discarded ones too."""
    files = as_files(derived(spark, sf_dir, FILES))
    return pii.tiered(files, ("cpf", "email")).select("path", "kind", "line", "tier", F.array_join("signals", ",").alias("signals"))


def kind_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all seven kinds with tier, confidence and mask, discarded ones too."""
    rows = pii.tiered(as_files(derived(spark, sf_dir, KINDS)))
    return rows.select("path", "kind", "line", "tier", "confidence", columns.masked(F.col("kind"), F.col("value")).alias("snippet"))


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tiers(spark, sf_dir).groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"))


def js_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.js_facts(as_files(derived(spark, sf_dir, JS)))
    return rows.select("path", "fact", "kind", "name", "provider", "line", "at", "snippet", "enclosing", "prev_comment")


def framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, MANIFESTS)
    files = rows.select("name", F.array("name").alias("parts"), "text")
    return facts.frameworks(files).select("framework", F.round("confidence", 9).alias("confidence"))


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, MANIFESTS)
    found = facts.config_facts(rows.select(F.concat(F.col("k").cast("string"), F.lit("/"), "name").alias("path"), "name", "text"))
    return found.where("fact != 'file'").select("path", "fact", "name", F.coalesce("value", F.lit("")).alias("value"))


def provider_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.operation_share(derived(spark, sf_dir, OPERATIONS))
    return rows.select("provider", F.round("share", 9).alias("share"))


def providers_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, MANIFESTS).select(F.concat(F.col("k").cast("string"), F.lit("/"), "name").alias("path"), "name", "text")
    return facts.providers_declared(facts.config_facts(rows))


def integration_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrations of the derived scan by family."""
    rows = derived(spark, sf_dir, OPERATIONS).where(F.col("kind").rlike("^(vector|memory|telemetry)"))
    return rows.groupBy(columns.category(F.col("kind")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, OPERATIONS)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tiers(spark, sf_dir).where("tier != 'discarded'")


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.register(risk_catalog(spark), _operations(spark, sf_dir), _findings(spark, sf_dir))


def risk_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored register of the derived scan, with the number of places of evidence."""
    return _risks(spark, sf_dir).select(
        "id", "nivel_inerente", "probabilidade_residual", "impacto_residual", "nivel_residual", "tratamento", "places",
    )


def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place, articles and mitigation that the findings list shows for each risk."""
    place = F.col("first_place")
    return _risks(spark, sf_dir).select(
        "id", place["file"].alias("file"), place["line"].alias("line"), place["kind"].alias("kind"), F.greatest(F.col("places") - 1, F.lit(0)).alias("more"),
        scan.articles(F.col("artigos")).alias("articles"), F.size("mitigacoes").alias("mitigations"),
    )


def risk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.verdict(_risks(spark, sf_dir), "Alto")


def gate_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.verdict(_risks(spark, sf_dir), None)


def gate_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.verdict(_risks(spark, sf_dir), "Crítico")


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.histogram(_risks(spark, sf_dir)).select("level", "n")


def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.residual_summary(_risks(spark, sf_dir))


def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks in the order of the findings list: worst first, then as in the catalog."""
    rows = _risks(spark, sf_dir).select("id", "ord", "nivel_inerente", columns.ordinal(F.col("nivel_inerente")).alias("o"))
    return rows.select("id", "nivel_inerente", F.row_number().over(Window.orderBy(F.desc("o"), "ord")).alias("place"))  # 28 rows at most


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each location of each result of the derived scan's SARIF log."""
    operations, findings, catalog = _operations(spark, sf_dir), _findings(spark, sf_dir), risk_catalog(spark)
    rows = scan.sarif_locations(risk.register(catalog, operations, findings), risk.evidence_rows(catalog, operations, findings))
    return rows.select("rule", "level", "uri", "line")


def empty_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the derived Python modules make an empty scan, and whether their build folder alone does."""
    found = python_facts(as_files(derived(spark, sf_dir, PY)))
    nothing = found.where("path LIKE 'build/%'")
    each = [risk.emptiness(f, 0.0).select(F.lit(name).alias("scan"), "empty") for name, f in (("all", found), ("build", nothing))]
    return each[0].union(each[1])


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python and JavaScript files that a scan of the derived tree reads."""
    files = as_files(derived(spark, sf_dir, JS)).union(as_files(derived(spark, sf_dir, PY)))
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("language"), "n") for name, rows in (("python", python_files(files)), ("javascript", facts.js_files(files)))]
    return counts[0].union(counts[1])


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that each given threshold names, and whether it names any (none names the gate that is off)."""
    rows = derived(spark, sf_dir, THRESHOLDS)
    known, level = columns.threshold(F.col("given"))
    return rows.groupBy("given").agg(F.count(F.lit(1)).alias("n")).select("given", known.alias("known"), level.alias("level"), "n")


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, ADDRESSES)
    return rows.select("page_id", urls.looks_clonable(F.col("url")).alias("clonable"))


def redacted_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations and entrypoints of a redacted scan: operations lose their source text, all else stays."""
    rows = facts.js_facts(as_files(derived(spark, sf_dir, JS)))
    found = scan.Scan(rows, _findings(spark, sf_dir).withColumn("snippet", F.lit("x")), rows, "unknown", 0.0, 0, 0)
    return scan.redacted(found).facts.select("path", "line", "fact", "kind", "snippet", "enclosing", "prev_comment")


def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of the derived files reports of CPF numbers and e-mail addresses, masked; ``kind_tiers`` has all kinds."""
    rows = pii.scan_pii(derived(spark, sf_dir, FILES).select("path", F.substring_index(F.substring_index("path", "#", 1), "/", -1).alias("name"), F.split("path", "/").alias("parts"), "text"))
    return rows.where(F.col("kind").isin("cpf", "email")).select("path", "kind", "line", "snippet", "confidence", "tier")


def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of Python modules derived from customers."""
    return python_facts(as_files(derived(spark, sf_dir, PY))).select(
        "path", "fact", "kind", "name", "provider", "model", "line", "at", "snippet", "enclosing", "prev_comment", "return_var", "url", F.array_join("parameters", ",").alias("parameters"),
    )


def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of the derived modules in canonical order."""
    needed = ("path", "fact", "kind", "name", "provider", "at")
    python, javascript = python_facts(as_files(derived(spark, sf_dir, PY))), facts.js_facts(as_files(derived(spark, sf_dir, JS)))
    rows = order.canonical(python.select(*needed), javascript.select(*needed))
    return rows.select("place", "lang", "path", "fact", "kind", "at")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_register(spark, sf_dir)


_NAMES = (
    numbers_valid, masked_numbers, documents_pii, pages_pii, path_class, context_tiers, kind_tiers, tier_counts, pii_findings, js_facts, framework, config_values,
    providers_declared, provider_share, integration_categories, risk_register, first_evidence, risk_gate, gate_off, gate_critical, risk_levels, residual_summary, findings_order,
    sarif_results, empty_scan, file_counts, thresholds, url_checks, redacted_operations, python_calls, scan_order,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


def oracle_sql() -> dict[str, str]:
    from riskweave.plans import oracles

    return oracles.sql(ROWS)

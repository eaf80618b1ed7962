"""Sinks and the reader of artifacts: same content as in memory, a row at a time."""

import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from riskweave.functions.catalog import risk_catalog
from riskweave.operators import facts, order, risk
from riskweave.plans import artifacts, scan


def made(spark, n):
    """A scan of n operations and findings."""
    ids = spark.range(n)
    columns = {"path": F.concat(F.lit("src/a"), (F.col("id") % 50).cast("string"), F.lit(".py")), "line": (F.col("id") % 900 + 1).cast("int"), "fact": F.lit("operation")}
    kinds = F.array(*[F.lit(k) for k in ("invoke_llm", "embed", "telemetry", "vector_store_write", "memory_persist")])
    rows = ids.withColumns(columns | {"kind": F.get(kinds, (F.col("id") % 5).cast("int")), "provider": F.lit("openai"), "snippet": F.concat(F.lit('é "]}\n,'), F.col("id").cast("string"))})
    names = [p.split() for p in facts.FACT.split(", ")]
    rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(" ".join(kind)).alias(c) for c, *kind in names])
    found = ids.select(
        F.lit("data.txt").alias("path"), F.lit("cpf").alias("kind"), F.lit(0).alias("seq"), F.col("id").cast("int").alias("line"), F.lit("***").alias("snippet"), F.lit(0.95).alias("confidence"),
        F.lit("high").alias("tier"), F.array(F.lit("keyword:cpf")).alias("signals"),
    )
    config = spark.createDataFrame([], "path string, fact string, name string, value string")
    return scan.Scan(rows, found, config, "langchain", 0.5, 3, 4)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("size", [100, 32 << 20])
def test_artifact_comes_back(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(artifacts, "RANGE", size)
    whole = made(spark, 300)
    path = str(tmp_path / "out/scan.json")
    scan.write_artifact(scan.artifact(spark, whole, "x"), path)
    body = json.loads(open(path, encoding="utf-8").read())["scan"]
    assert len(body["facts"]) == len(body["pii_findings"]) == 300 and body["config"] == [] and len(body["vector_stores"]) == len(body["memory_stores"]) == 60
    again = scan.read_artifact(spark, path)
    for name in ("facts", "findings", "config"):
        assert rows_of(getattr(again, name)) == rows_of(getattr(whole, name)), name
    assert (again.framework, again.confidence, again.files_py, again.files_js) == ("langchain", 0.5, 3, 4)
    assert (again.facts.rdd.getNumPartitions() > 20) == (size == 100)
    pretty = tmp_path / "pretty.json"  # as other tools lay it out
    pretty.write_text(json.dumps(json.loads(open(path, encoding="utf-8").read()), indent=4))
    assert rows_of(scan.read_artifact(spark, str(pretty)).facts) == rows_of(whole.facts)
    text = open(path, encoding="utf-8").read()
    for bad in ("{", "[1]", text[: len(text) // 2], text.replace('"format"', '"other"', 1)):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="(?i)scan|json|malformed|layout|lacks"):
            broken = scan.read_artifact(spark, str(tmp_path / "bad.json"))
            rows_of(broken.facts), rows_of(broken.findings)


def test_a_wrong_row_fails_the_read(spark, tmp_path):
    path = tmp_path / "scan.json"
    scan.write_artifact(scan.artifact(spark, made(spark, 20), "x"), str(path))
    path.write_text(path.read_text().replace('"line":7', '"line":"seven"', 1))
    with pytest.raises(Exception, match="(?i)malformed"):
        scan.read_artifact(spark, str(path)).facts.collect()


def test_sarif_is_what_it_was_and_the_driver_holds_no_locations(spark, tmp_path):
    known = risk_catalog(spark)
    for n in (0, 40):
        whole = made(spark, n)
        register = risk.register(known, whole.operations, whole.findings)
        scan.write_sarif_log(register, risk.evidence_rows(known, whole.operations, whole.findings), str(tmp_path / "a.sarif"))
        want = json.loads(scan.sarif(scan.register_of(spark, whole)).first()["sarif"])
        got = json.loads((tmp_path / "a.sarif").read_text(encoding="utf-8"))
        assert got == want
    whole = made(spark, 60_000)
    register = risk.register(known, whole.operations, whole.findings)
    tracemalloc.start()
    scan.write_sarif_log(register, risk.evidence_rows(known, whole.operations, whole.findings), str(tmp_path / "b.sarif"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (tmp_path / "b.sarif").stat().st_size > 8 << 20 > 4 * peak


def test_numbering_is_total_and_in_order(spark):
    rows = [(k * 7919 % 1000, None if k % 3 else "x") for k in range(1000)] + [(5, "same")] * 500
    out = order.numbered(spark.createDataFrame(rows, "a long, b string").repartition(7), ["a", "b"], "place").collect()
    by = sorted(out, key=lambda r: r["place"])
    assert [r["place"] for r in by] == list(range(1, len(rows) + 1))
    keys = [(r["a"], r["b"] is not None, r["b"] or "") for r in by]
    assert keys == sorted(keys)

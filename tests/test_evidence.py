"""Evidence stays rows: no array of all places in the register, no list of all facts on the driver."""

import json

from pyspark.sql import DataFrame

from riskweave.functions.catalog import risk_catalog
from riskweave.operators import facts, risk
from riskweave.plans import registry
from riskweave.plans import scan as plan


def test_register_counts_places(spark):
    ops = spark.createDataFrame([("b.py", 3, "telemetry", "langsmith"), ("a.py", 9, "telemetry", "langsmith"), ("a.py", 9, "telemetry", "langsmith")], "path string, line int, kind string, provider string")
    found = spark.createDataFrame([(f"p{i:04}", 1, "cpf", "high") for i in range(500)], "path string, line int, kind string, tier string")
    catalog = risk_catalog(spark)
    rows = risk.register(catalog, ops, found)
    assert "evidencia" not in rows.columns
    listed = {r["id"]: r["evidencia"] for r in risk.with_evidence(rows, catalog, ops, found).collect()}
    got = {r["id"]: r for r in rows.collect()}
    assert got.keys() == listed.keys() and max(r["places"] for r in got.values()) >= 500
    for k, r in got.items():
        assert r["places"] == len(listed[k]) and r["first_place"] == (listed[k][0] if listed[k] else None)
    plan_text = registry.risk_register(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan_text


def test_artifact_lists_are_frames(spark, tmp_path):
    none = spark.createDataFrame([], facts.FACT)
    found = spark.createDataFrame([("a\n\"é", "cpf", 1)], "path string, kind string, line int")
    config = spark.createDataFrame([("x", "file", "x")] * 3, "path string, fact string, name string")
    data = plan.artifact(spark, plan.Scan(none, found, config, "none", 0.5, 1, 0), "l")
    assert all(isinstance(data["scan"][k], DataFrame) for k in ("facts", "pii_findings", "config"))
    plan.write_artifact(data, str(tmp_path / "s.json"))
    read = json.loads((tmp_path / "s.json").read_text(encoding="utf-8"))
    assert read["format"] == plan.FORMAT and read["scan"]["facts"] == [] and len(read["scan"]["config"]) == 3
    assert read["scan"]["pii_findings"] == [{"path": "a\n\"é", "kind": "cpf", "line": 1}]

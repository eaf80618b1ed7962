"""Matches within rows: repeated and null keys, groups, very many matches, and what depends on lines."""

import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions import catalog, columns, urls
from riskweave.operators import facts, pii, risk
from riskweave.operators.matches import BLOCK, matches
from riskweave.plans import scan as plan
from riskweave.sources import tree


def test_lines_of_repeated_and_null_keys(spark):
    texts = ["x\n\nto a@b.org", "y\n\nto c@d.org", "z", None, ""]
    rows = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[0]), (1, texts[2]), (2, texts[3]), (2, texts[4])], "k int, t string")
    got = pii.candidate_matches(rows, ["k"], "t", ("email",)).collect()
    assert sorted((str(r["k"]), r["value"], r["line"], r["at"]) for r in got) == [("1", "a@b.org", 3, 6), ("1", "c@d.org", 3, 6), ("None", "a@b.org", 3, 6)]


@pytest.mark.parametrize("n", [1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 3])
def test_many_matches_and_groups(spark, n):
    text = "\uffff\n" + "".join(f"k{i}=v\n" if i % 3 else f"\n\nkey {i} = ;" for i in range(n))
    pattern = r"(\d+)(\s?)="
    want = [(i, m[0], text.count("\n", 0, m.start()) + 1, m.start(), [m[1], m[2]]) for i, m in enumerate(re.finditer(pattern, text))]
    rows = matches(spark.createDataFrame([(text,)], "t string"), [], "t", [("x", pattern, 2)]).collect()
    assert [(r["seq"], r["value"], r["line"], r["at"], r["groups"]) for r in rows] == want and len(want) == n


def test_repeated_paths_keep_their_own_lines(spark):
    """Two files of one path: each takes keywords and markers from its own text."""
    rows = tree.named(spark.createDataFrame([("a.py", "# cpf\n529.982.247-25"), ("a.py", "\n\n# sample cpf\n529.982.247-25")], "path string, text string"))
    assert sorted((r["line"], r["tier"]) for r in pii.tiered(rows, ("cpf",)).collect()) == [(2, "high"), (4, "low")]


def test_comment_above_many_empty_lines(spark):
    text = "// far up" + "\n" * 40 + "const a = embed(x)\n \nembed(y)"
    rows = tree.named(spark.createDataFrame([("a.ts", text), ("b.ts", "embed(z)")], "path string, text string"))
    got = {(r["path"], r["line"]): (r["prev_comment"], r["enclosing"], r["snippet"]) for r in facts.js_facts(rows).collect()}
    assert got == {("a.ts", 41): ("far up", "a", "const a = embed(x)"), ("a.ts", 43): (None, "a", "embed(y)"), ("b.ts", 1): (None, None, "embed(z)")}


def test_column_form_of_the_url_check(spark):
    """What the driver's check says, for whole columns."""
    hosts = ["127.1", "0x7f.1", "10.0.0.1", "8.8.8.8", "1.2.3.4.5", "010.8.8.8", "256.1.1.1", "4294967295", "4294967296", "09.1.1.1", "192.0.2.1", "172.32.0.1", "172.31.9.9", "a.b", "0", "100.64.0.1", "198.18.0.1", "203.0.113.9", "224.0.0.1", "1.", "169.254.7"]
    cases = [f"https://{h}{tail}" for h in hosts for tail in ("/x", ":444/x", "")] + ["http://a.org", "https://u@a.org", "https://", "https://a b", "x" * 3000, " https://a.org ", None]
    rows = spark.createDataFrame([(u,) for u in cases], "u string")

    def driver(u):
        try:
            return bool(urls.checked_git_url(u)) if u is not None else False
        except urls.UnsafeGitUrlError:
            return False

    got = [(r["u"], r["ok"]) for r in rows.select("u", urls.looks_clonable(F.col("u")).alias("ok")).collect()]
    assert got == [(u, driver(u)) for u in cases]


def test_unread_files_fail_the_scan(spark, tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("x")
    reader = tree.TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    (tmp_path / "a.py").unlink()  # as on a machine that doesn't see the folder
    with pytest.raises(OSError):
        list(reader.read(parts[0]))


def test_providers_once_in_first_seen_order(spark):
    rows = tree.named(spark.createDataFrame([("b/.env", "OPENAI_API_KEY=1"), ("c/.env", "OPENAI_API_KEY=1\nANTHROPIC_API_KEY=1"), ("d/.env", "AZURE_OPENAI=1"), ("a/x.txt", "GEMINI_API_KEY=1")], "path string, text string"))
    got = facts.providers_declared(facts.config_facts(rows)).orderBy("place").collect()
    assert [(r["name"], r["place"]) for r in got] == [("openai", 1), ("anthropic", 2), ("azure_openai", 3)]


def test_first_rule_of_an_id_wins(spark):
    schema = "ord int, id string, nivel_inerente string, categoria string, descricao string, artigos array<string>, evidencia array<struct<file: string, line: int, kind: string>>"
    rows = spark.createDataFrame([(2, "R", "Baixo", "c", "later", [], []), (1, "R", "Alto", "c", "first", ["Art. 1"], [("f", 0, "k"), ("", 1, "k")])], schema)
    import json

    run = json.loads(plan.sarif(rows).first()["sarif"])["runs"][0]
    assert [r["shortDescription"]["text"] for r in run["tool"]["driver"]["rules"]] == ["first"] and run["results"][0]["level"] == "error"
    assert run["results"][0]["locations"] == [{"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 1}}}]


def test_thresholds_as_columns(spark):
    given = [" Médio ", "off", "x", None, "", "HIGH"]
    known, level = columns.threshold(F.col("g"))
    rows = spark.createDataFrame([(g,) for g in given], "g string").select(known, level).collect()
    assert [tuple(r) for r in rows] == [(True, "Médio"), (True, None), (False, None), (True, None), (True, None), (True, "Alto")]
    assert risk.FLAG_ORDER["pii"] == 1


def test_artifact_without_a_list_is_refused(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"format": "%s", "scan": {"facts": []}}' % plan.FORMAT)
    with pytest.raises(plan.ScanArtifactError):
        plan.read_artifact(spark, str(tmp_path / "s.json"))


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "risks.json"
    catalog.write_catalog(str(path))
    assert catalog.read_catalog(str(path)) == catalog.ROWS
    path.write_text('[{"id": "X-1", "categoria": "c", "descricao": "d", "p": 4, "i": 5, "flags": ["always"], "mitigacoes": [{"text": "m", "impact": 1}]}]')
    rows = catalog.read_catalog(str(path))
    none = spark.createDataFrame([], facts.FACT)
    found = spark.createDataFrame([], "path string, kind string, line int, tier string")
    got = risk.register(catalog.risk_catalog(spark, rows), none, found).collect()
    assert [(r["id"], r["nivel_inerente"], r["impacto_residual"], r["mitigacoes"]) for r in got] == [("X-1", "Crítico", 4, ["m"])]
    for bad in ("{}", "[1]", '[{"id": "X"}]', '[{"id": "X", "categoria": "c", "descricao": "d", "p": 9, "i": 1}]', "nothing"):
        path.write_text(bad)
        with pytest.raises(catalog.CatalogError):
            catalog.read_catalog(str(path))

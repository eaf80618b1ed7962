"""The scan on trees and rows made here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from riskweave import cli
from riskweave.functions import columns, rules, urls
from riskweave.functions.catalog import risk_catalog
from riskweave.operators import facts, pii, risk
from riskweave.operators.python_facts import python_facts
from riskweave.plans import scan as plan
from riskweave.sources import tree

AGENT = '''import httpx
import redis
import redis.asyncio as ra
from redis import Redis as R
from redis import Redis
from pinecone import Pinecone
from langsmith import Client

trace = Client()
pc = Pinecone(); index = pc.Index("x")
alias = R()
store = Redis()


@app.post("/ask")
async def ask(q):
    # ask the model
    answer = await client.chat.completions.create(model="m-1", messages=[q])
    index.upsert([1])
    store.query(1)
    self.x.query()
    return httpx.post(f"https://{q}")


@tool
def look(self, word):
    """Looks up."""
    return requests.get("https://a.org")


def handler(event, context):
    vectors = emb.embed_query("x")


if __name__ == "__main__":
    ask(1)
'''
PAGE = """import { generateText } from 'ai'
export async function POST(req) {
  // produce it

  const text = generateText({})
}
app.get('/v1', h)
tool({ a: 1 })
"""


def files_of(spark, rows):
    return tree.named(spark.createDataFrame(rows, "path string, text string"))


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "project"
    for name, text in {
        "app/agent.py": AGENT,
        "app/broken.py": "def (",
        "web/route.ts": PAGE,
        "data/people.json": '{"cpf": "529.982.247-25",\n "email": "a@b.org"}',
        ".env": "OPENAI_API_KEY=1\nX_BASE_URL='https://h'\nCACHE_TTL=\n30\n",
        "node_modules/x.py": "import httpx",
        "requirements.txt": "langchain-core\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "bad.txt").write_bytes(b"cpf 529.982.247-25 \xff\r\nx")
    return root


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (columns.is_cpf, ["529.982.247-25", "11144477735"], ["529.982.247-24", "11111111111", "", "123"]),
        (columns.is_cnpj, ["11.222.333/0001-81"], ["11.222.333/0001-82", "00000000000000"]),
        (columns.is_cnh, ["98765432100"], ["98765432101"]),
        (columns.is_titulo_eleitor, ["123456780183"], ["123456782983", "000000000000"]),
        (columns.is_pis, ["12056412547"], ["12056412548"]),
    ],
)
def test_check_digits(spark, check, good, bad):
    def digits_of(v):
        return [int(c) for c in v if c.isdigit()]

    if check is columns.is_cnh:  # make a number that is right by its definition
        d = [9, 8, 7, 6, 5, 4, 3, 2, 1]
        one = sum(x * w for x, w in zip(d, range(9, 0, -1))) % 11
        two = sum(x * w for x, w in zip(d, range(1, 10))) % 11 - (2 if one >= 10 else 0)
        two = two + 11 if two < 0 else two
        good = ["987654321" + str(0 if one >= 10 else one) + str(0 if two >= 10 else two)]
        bad = [good[0][:-1] + str((int(good[0][-1]) + 1) % 10)]
    if check is columns.is_titulo_eleitor:
        d = [1, 2, 3, 4, 5, 6, 7, 8, 0, 1]
        one = sum(x * w for x, w in zip(d, range(2, 10))) % 11 % 10
        good = ["1234567801" + str(one) + str((0 * 7 + 1 * 8 + one * 9) % 11 % 10)]
    if check is columns.is_pis:
        d = digits_of("1205641254")
        r = 11 - sum(x * w for x, w in zip(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2])) % 11
        good, bad = ["1205641254" + str(0 if r >= 10 else r)], ["1205641254" + str((0 if r >= 10 else r) + 1)]
    rows = spark.createDataFrame([(v,) for v in [*good, *bad, None]], "v string").select("v", check(F.col("v")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True] * len(good) + [False] * (len(bad) + 1)


def test_match_lines_cross_newlines(spark):
    rows = files_of(spark, [("a.txt", "tel 55\n11 91234-5678\n\nx 55 11 91234-5678 and a@b.org"), ("b.txt", "")])
    found = {(r["kind"], r["line"]) for r in pii.candidates(rows).collect()}
    assert found == {("phone", 1), ("phone", 4), ("email", 4)}


def test_tiers(spark):
    cpf = "529.982.247-25"
    gap = lambda n: "\n".join("x" for _ in range(n))
    rows = files_of(
        spark,
        [
            ("a.py", f"customer_cpf = 1\n{gap(4)}\n{cpf}"),  # keyword five lines up
            ("b.py", f"customer_cpf = 1\n{gap(5)}\n{cpf}"),  # six: out of reach
            ("c.py", f"cpfcheck\n{cpf}"),
            ("d.py", f"cpf {cpf}\n# sample"),
            ("e.py", f"# sample\n{gap(3)}\n{cpf}"),  # marker four lines up
            ("tests/f.py", f"cpf {cpf}"),
            ("tests/g.py", cpf),
            ("h.py", f'cpf r"{cpf}"'),
            ("i.py", "a@b.org"),
            ("README.md", f"cpf {cpf}"),
            ("j.md", f"* fake cpf\n{cpf}"),
            ("k.py", f"mock_user = 1\ncpf {cpf}"),
        ],
    )
    got = {r["path"]: (r["tier"], r["signals"]) for r in pii.tiered(rows, ("cpf", "email")).collect()}
    assert got == {
        "a.py": ("high", ["keyword:cpf"]),
        "b.py": ("low", ["checksum_only"]),
        "c.py": ("low", ["checksum_only"]),
        "d.py": ("low", ["keyword:cpf", "marker:sample"]),
        "e.py": ("low", ["checksum_only"]),
        "tests/f.py": ("low", ["keyword:cpf", "test_path"]),
        "tests/g.py": ("discarded", ["test_path"]),
        "h.py": ("low", ["keyword:cpf", "regex_artifact"]),
        "i.py": ("discarded", []),
        "README.md": ("low", ["keyword:cpf", "meta_path"]),
        "j.md": ("low", ["keyword:cpf", "marker:fake"]),
        "k.py": ("low", ["keyword:cpf", "var_marker:mock"]),
    }
    assert pii.scan_pii(rows, require_context=False).where("tier = 'high'").count() >= 12


def test_python_and_js_facts(spark):
    rows = files_of(spark, [("app/agent.py", AGENT), ("app/broken.py", "def ("), ("web/route.ts", PAGE), ("web/empty.js", "")])
    got = [(r["fact"], r["kind"], r["provider"], r["line"]) for r in python_facts(rows).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("operation", "telemetry", "langsmith", 9), ("operation", "vector_store_init", "pinecone", 10), ("operation", "memory_persist", "redis", 12),
            ("entrypoint", "fastapi", None, 16), ("operation", "invoke_llm", "openai", 18), ("operation", "vector_store_write", "pinecone", 19),
            ("operation", "vector_store_read", "redis", 20), ("external_call", "POST", "httpx", 22), ("tool", None, None, 26), ("external_call", "GET", "requests", 28),
            ("entrypoint", "aws_lambda", None, 31), ("operation", "embed", "langchain", 32), ("entrypoint", "script", None, 35),
        ],
        key=str,
    )
    call = python_facts(rows).where("kind = 'invoke_llm'").first()
    assert (call["model"], call["enclosing"], call["return_var"], call["prev_comment"]) == ("m-1", "ask", "answer", "ask the model")
    tool = python_facts(rows).where("fact = 'tool'").first()
    assert (tool["name"], tool["parameters"], tool["snippet"]) == ("look", ["word"], "Looks up.")
    js = {(r["fact"], r["kind"], r["name"], r["provider"], r["line"], r["enclosing"], r["prev_comment"]) for r in facts.js_facts(rows).collect()}
    assert js == {
        ("entrypoint", "nextjs_route", "POST", None, 2, None, None), ("operation", "invoke_llm", None, "vercel_ai_sdk", 5, "text", "produce it"),
        ("entrypoint", "express_route", "/v1", None, 7, None, None), ("tool", "tool", "tool(...)", None, 8, None, None),
    }


def test_config_and_framework(spark):
    rows = files_of(spark, [(".env", "OPENAI_API_KEY=1\nX_BASE_URL='https://h'\nCACHE_TTL=\n30\n"), ("setup.py", "from openai import x"), ("a.py", "from anthropic import y"), ("node_modules/Dockerfile", "A_ENDPOINT: b")])
    found = {(r["fact"], r["name"], r["value"]) for r in facts.config_facts(rows).where("fact != 'file'").collect()}
    assert found == {("provider", "openai", None), ("base_url", "X_BASE_URL", "https://h"), ("retention", "CACHE_TTL", "30"), ("base_url", "A_ENDPOINT", "b")}
    name, confidence = facts.frameworks(rows).first()
    assert (name, round(confidence, 6)) == ("openai_sdk", round(2 / 3, 6))  # setup.py counts twice
    assert tuple(facts.frameworks(rows.where("false")).first()) == ("unknown", 0.0)


def test_catalog_scores(spark):
    rows = {r["id"]: r for r in risk.scored(risk_catalog(spark)).collect()}
    got = {k: (r["nivel_inerente"], r["probabilidade_residual"], r["impacto_residual"], r["nivel_residual"]) for k, r in rows.items()}
    assert got["AI-001"] == ("Alto", 2, 4, "Médio") and got["AI-002"] == ("Alto", 2, 3, "Médio") and got["AI-013"] == ("Médio", 1, 3, "Baixo")
    assert got["AI-006"] == ("Alto", 3, 2, "Médio") and got["CL-010"] == ("Médio", 2, 3, "Médio") and got["CL-002"] == ("Médio", 1, 3, "Baixo")
    assert len(rows) == 28


def test_empty_scan_has_the_risks_that_always_apply(spark):
    ops = spark.createDataFrame([], facts.FACT)
    found = spark.createDataFrame([], "path string, kind string, line int, tier string")
    register = risk.register(risk_catalog(spark), ops, found)
    assert [r["id"] for r in register.collect()] == ["CL-001", "CL-002", "CL-003", "CL-004", "CL-006", "CL-008", "CL-010"]
    assert {r["level"]: r["n"] for r in risk.histogram(register).collect()} == {"Baixo": 0, "Médio": 5, "Alto": 2, "Crítico": 0}
    none = register.where("false")
    assert tuple(risk.verdict(none, "Baixo").first()) == (0, None, "Baixo", False, 0)


def test_whole_scan_and_artifact(spark, project, tmp_path):
    found = plan.scan_tree(tree.read_tree(spark, str(project)))
    assert (found.framework, found.files_py, found.files_js) == ("langchain", 2, 1)
    assert {r["path"] for r in found.findings.collect()} == {"data/people.json", "bad.txt"}
    register = plan.register_of(spark, found)
    log = json.loads(plan.sarif(register).first()["sarif"])
    results = log["runs"][0]["results"]
    assert log["version"] == "2.1.0" and [r["ruleId"] for r in results] == [r["id"] for r in register.collect()]
    assert next(r for r in results if r["ruleId"] == "CL-001")["locations"] == [{"physicalLocation": {"artifactLocation": {"uri": "."}}}]
    plan.write_artifact(plan.artifact(spark, found, "x", redact=True), str(tmp_path / "out/scan.json"))
    again = plan.read_artifact(spark, str(tmp_path / "out/scan.json"))
    assert again.operations.where("snippet != '' OR prev_comment IS NOT NULL").count() == 0
    drop = [c for c in register.columns if c != "evidencia"]
    assert [tuple(r[c] for c in drop) for r in plan.register_of(spark, again).collect()] == [tuple(r[c] for c in drop) for r in register.collect()]
    (tmp_path / "other.json").write_text('{"format": "x"}')
    with pytest.raises(plan.ScanArtifactError):
        plan.read_artifact(spark, str(tmp_path / "other.json"))


def test_command_line(spark, project, tmp_path, capsys):
    summary, log = tmp_path / "s.md", tmp_path / "r.sarif"
    assert cli.main(["check", str(project), "--fail-on", "high", "--summary-md", str(summary), "--sarif", str(log), "--json"]) == 4
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["breached"] and out["worst"] == "Alto" and out["counts"]["Crítico"] == 0
    assert "Reprovado" in summary.read_text() and "`AI-001`" in summary.read_text() and json.loads(log.read_text())["runs"]
    assert cli.main(["check", str(project), "--fail-on", "critico"]) == 0
    assert cli.main(["check", str(tmp_path / "none")]) == 2 and cli.main(["check", str(project), "--fail-on", "x"]) == 2
    (tmp_path / "empty").mkdir()
    assert cli.main(["check", str(tmp_path / "empty")]) == 3 and cli.main([]) == 1


def test_archives_and_addresses(tmp_path):
    good, bad = tmp_path / "a.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x/y.py", "1")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../y.py", "1")
    assert (tree.unpack(good, tmp_path / "t") / "x/y.py").read_text() == "1"
    with pytest.raises(tree.UnsafeZipError):
        tree.unpack(bad, tmp_path / "u")
    assert urls.checked_git_url(" https://example.org/a.git ") == "https://example.org/a.git"
    for url in ("http://a.org", "git@a.org:x", "ext::sh", "https://u@a.org", "https://127.1/x", "https://0x7f000001/", "https://[::1]/", "https://", "https://a b"):
        with pytest.raises(urls.UnsafeGitUrlError):
            urls.checked_git_url(url)
    with pytest.raises(urls.UnsafeGitUrlError):
        urls.checked_git_url("https://a.org", {"b.org"})


def test_thresholds_and_masks(spark):
    assert plan.parse_threshold(" Médio ") == "Médio" and plan.parse_threshold("off") is None
    with pytest.raises(plan.ThresholdError):
        plan.parse_threshold("x")
    rows = spark.createDataFrame([("cpf", "52998224725"), ("cnh", "1234"), ("cep", "01310-100"), ("phone", "1")], "k string, v string")
    assert [r[0] for r in rows.select(columns.masked(F.col("k"), F.col("v"))).collect()] == ["***.***.***-25", "…", "01310-100", "[phone]"]
    assert len(rules.CANDIDATES) == 7

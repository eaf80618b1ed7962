"""A whole tree of our own: every fact, finding and risk that reading it by hand gives, and the gate's verdict."""

import collections
import json

import pytest

from riskweave import cli
from riskweave.functions.catalog import risk_catalog
from riskweave.operators import risk
from riskweave.plans import scan

TREE = {
    "app/main.py": "from fastapi import FastAPI\n\napp = FastAPI()\n\n\n@app.post('/claims')\nasync def create(claim):\n    return await triage(claim)\n\n\n@app.get('/claims')\ndef listed():\n    return []\n",
    "app/agent.py": (
        "from langsmith import Client\n\ntracer = Client()\n\n\ndef triage(claim):\n    # which queue is it for\n"
        '    first = client.chat.completions.create(model="m-1", messages=[claim])\n\n    second = other.messages.create(model=name, messages=[claim])\n    return first, second\n'
    ),
    "app/index.py": 'from pinecone import Pinecone\n\npc = Pinecone(api_key=key)\nindex = pc.Index("claims")\n\n\ndef search(text):\n    vector = llm.embeddings.create(model="e-1", input=text)\n    return index.query(vector)\n\n\ndef store(rows):\n    index.upsert(rows)\n',
    "app/memory.py": "import redis\nfrom langchain_community.chat_message_histories import RedisChatMessageHistory\n\nconn = redis.Redis.from_url(url)\n\n\ndef history(key):\n    return RedisChatMessageHistory(key)\n",
    "app/review.py": "import httpx\n\n\ndef review(claim):\n    return httpx.post(f'{base}/review', json=claim)\n\n\ndef policy(number):\n    return httpx.get(f'{base}/policy/{number}')\n",
    "app/claim.py": "from pydantic import BaseModel\n\n\nclass Claim(BaseModel):\n    number: str\n",
    "web/route.ts": "import { generateText, streamText } from 'ai'\n\nconst find = tool({ name: 'find' })\n\nexport async function POST(req) {\n  // answer it\n  return generateText({ model })\n}\n\nexport async function PUT(req) {\n  return streamText({ model })\n}\n",
    "web/page.tsx": "export default function Page() {\n  return null\n}\n",
    "web/package.json": '{"name": "web"}\n',
    "Dockerfile": "FROM scratch\n",
    "data/sample_claims.json": '{"cpf": "529.982.247-25",\n "telefone": "+55 11 91234-5678",\n "email": "ana@seguros.com.br",\n "apolice": "12345"},\n{"cnpj": "11.222.333/0001-81"}\n',
    "logo.png": "cpf 529.982.247-25",
    "node_modules/x/index.py": "import httpx\nhttpx.get('https://h')\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("own")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return root


def test_facts_findings_and_risks(spark, tree):
    found = scan.scan_directory(spark, str(tree))
    facts = sorted((r["path"], r["line"], r["fact"], r["kind"] or "", r["provider"] or "", r["model"] or "", r["enclosing"] or "") for r in found.facts.collect())
    assert facts == [
        ("app/agent.py", 3, "operation", "telemetry", "langsmith", "", ""), ("app/agent.py", 8, "operation", "invoke_llm", "openai", "m-1", "triage"), ("app/agent.py", 10, "operation", "invoke_llm", "anthropic", "", "triage"),
        ("app/index.py", 3, "operation", "vector_store_init", "pinecone", "", ""), ("app/index.py", 8, "operation", "embed", "openai", "e-1", "search"),
        ("app/index.py", 9, "operation", "vector_store_read", "pinecone", "", "search"), ("app/index.py", 13, "operation", "vector_store_write", "pinecone", "", "store"),
        ("app/main.py", 7, "entrypoint", "fastapi", "", "", ""), ("app/main.py", 12, "entrypoint", "fastapi", "", "", ""), ("app/memory.py", 8, "operation", "memory_persist", "langchain_redis", "", "history"),
        ("app/review.py", 5, "external_call", "POST", "httpx", "", "review"), ("app/review.py", 9, "external_call", "GET", "httpx", "", "policy"),
        ("web/route.ts", 3, "tool", "tool", "", "", ""), ("web/route.ts", 5, "entrypoint", "nextjs_route", "", "", ""), ("web/route.ts", 7, "operation", "invoke_llm", "vercel_ai_sdk", "", "POST"),
        ("web/route.ts", 10, "entrypoint", "nextjs_route", "", "", ""), ("web/route.ts", 11, "operation", "invoke_llm", "vercel_ai_sdk", "", "PUT"),
    ]
    findings = sorted((r["path"], r["line"], r["kind"], r["tier"], r["snippet"]) for r in found.findings.collect())
    data = "data/sample_claims.json"
    assert findings == [(data, 1, "cpf", "high", "***.***.***-25"), (data, 2, "phone", "high", "[phone]"), (data, 3, "email", "high", "[email]"), (data, 5, "cnpj", "high", "**.***.***/****-81")]
    assert (found.files_py, found.files_js) == (6, 2)
    # Each rule once more in plain Python: always, by an operation's kind, or by a flag.
    known = risk_catalog(spark).collect()
    kinds = {f[3] for f in facts if f[2] == "operation"}
    flags = {"always", "pii", "external_provider", "telemetry", "memory_store", "vector_store"}
    want = [r["id"] for r in known if set(r["operations"] or ()) & kinds or set(r["flags"] or ()) & flags]
    register = risk.register(risk_catalog(spark), found.operations, found.findings).collect()
    assert [r["id"] for r in register] == want and len(want) == 27  # all but the one that asks for what this tree doesn't have
    assert collections.Counter(r["nivel_inerente"] for r in register) == {"Alto": 16, "Médio": 11} and collections.Counter(r["nivel_residual"] for r in register) == {"Médio": 17, "Baixo": 10}
    places = collections.Counter(r["id"] for r in risk.evidence_rows(risk_catalog(spark), found.operations, found.findings).collect())
    assert {r["id"]: r["places"] for r in register} == {i: places.get(i, 0) for i in want}
    found.release()


def test_gate(spark, tree, tmp_path, capsys):
    assert cli.main(["check", str(tree), "--fail-on", "alto", "--json", "--sarif", str(tmp_path / "r.sarif"), "--scan-out", str(tmp_path / "scan.json"), "--redact"]) == 4
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (out["operations"], out["pii_findings"], out["breached"], out["redacted"]) == (10, 4, True, True)
    results = json.loads((tmp_path / "r.sarif").read_text(encoding="utf-8"))["runs"][0]["results"]
    assert len(results) == out["total"] == sum(out["counts"].values())
    body = (tmp_path / "scan.json").read_text(encoding="utf-8")
    assert "which queue" not in body and "***.***.***-25" not in body
    again = scan.read_artifact(spark, str(tmp_path / "scan.json"))
    assert len(risk.register(risk_catalog(spark), again.operations, again.findings).collect()) == out["total"]

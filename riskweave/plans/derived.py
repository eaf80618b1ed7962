"""SQL that derives source files, operations and addresses from the driver's tables, row by row; both engines run it."""

from __future__ import annotations

NUMBERS = """
SELECT o_orderkey AS k, lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR(20)), 9, '0') || lpad(CAST(o_orderkey % 100 AS VARCHAR(20)), 2, '0') AS v11,
  lpad(CAST(o_orderkey * 104729 % 1000000000000 AS VARCHAR(20)), 12, '0') || lpad(CAST(o_orderkey % 89 AS VARCHAR(20)), 2, '0') AS v14,
  lpad(CAST(o_orderkey * 7 % 100000000 AS VARCHAR(20)), 8, '0') || lpad(CAST(o_orderkey % 31 AS VARCHAR(20)), 2, '0') || lpad(CAST(o_orderkey % 97 AS VARCHAR(20)), 2, '0') AS v12
FROM orders
"""
#: Files of a few lines: an identifier, an e-mail address and a phone number, with keywords, markers and patterns near some.
FILES = (
    "SELECT CASE k % 7 WHEN 0 THEN 'src/a' || k || '.py' WHEN 1 THEN 'tests/a' || k || '.py' WHEN 2 THEN 'docs/a' || k || '.md' WHEN 3 THEN 'pkg/README.md'"
    " WHEN 4 THEN 'src/a' || k || '_test.py' WHEN 5 THEN 'src/conftest.py' ELSE 'lib/b' || k || '.py' END || '#' || k AS path,"
    " concat_ws(chr(10), CASE WHEN k % 3 = 0 THEN 'customer_cpf = 1' ELSE 'value = 2' END, CASE WHEN k % 5 = 0 THEN '# sample row' ELSE '# row' END, 'x = 1', 'y = 2',"
    " CASE WHEN k % 11 = 0 THEN 'number r\"' ELSE 'number \"' END || v11 || '\"', CASE WHEN k % 4 = 0 THEN 'user-email: u' || k || '@mail.example.com' ELSE 'to u' || k || '@host.org' END, 'z = 3',"
    " CASE WHEN k % 6 = 0 THEN 'mock_data = [' ELSE 'data = [' END, 'tel +55 11 9' || substr(v11, 1, 4) || '-' || substr(v11, 5, 4), ']') AS text"
    f" FROM ({NUMBERS})"
)
#: Files with a value of every kind, far enough from each other that each has only its own line of context, with or without a keyword.
KINDS = (
    "SELECT 'src/k' || k || '.txt' AS path, concat_ws(chr(10),"
    + ", repeat('-' || chr(10), 5) || '-', ".join(
        f"CASE WHEN k % {n} = 0 THEN '{word}' ELSE 'value' END, {value}"
        for n, word, value in (
            (2, "cnpj", "v14"), (3, "titulo", "v12"), (5, "telefone", "'+55 11 9' || substr(v11, 1, 4) || '-' || substr(v11, 5, 4)"),
            (7, "cep", "substr(v11, 1, 5) || '-' || substr(v11, 6, 3)"), (4, "cnh", "v11"),
        )
    )
    + f") AS text FROM ({NUMBERS})"
)
#: TypeScript modules of different imports, handlers, calls and comments.
JS = """
SELECT CASE c_custkey % 9 WHEN 8 THEN 'node_modules/r' ELSE 'web/r' END || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.mjs' ELSE '.css' END AS path, concat_ws(chr(10),
  CASE c_custkey % 5 WHEN 0 THEN 'import { generateText } from ''ai''' WHEN 1 THEN 'import OpenAI from "openai"' WHEN 2 THEN 'import A from ''@anthropic-ai/sdk''' WHEN 3 THEN 'import { x } from "@ai-sdk/y"' ELSE '// none' END,
  CASE c_custkey % 4 WHEN 0 THEN 'const handle' || c_custkey || ' = async (req) => {' ELSE 'export async function ' || CASE c_custkey % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' ELSE 'DELETE' END || '(req) {' END,
  CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '  //' WHEN 2 THEN '  start()' ELSE '  // ask model ' || c_custkey END,
  CASE c_custkey % 6 WHEN 0 THEN '  client.messages.create(y)' WHEN 1 THEN '  return embed(y)' WHEN 2 THEN '  const b = streamText ({y})' ELSE '  const a = generateText({x: ' || c_custkey || '})' END,
  CASE WHEN c_custkey % 8 = 3 THEN '' ELSE '}' END, CASE WHEN c_custkey % 2 = 0 THEN 'app.get("/v1/' || c_custkey || '", h)' ELSE 'embedMany(y); app.use(''/z'')' END,
  CASE WHEN c_custkey % 5 = 2 THEN 'tool(x)' ELSE 'tool({ name: 1 })' END) AS text
FROM customer
"""
#: Python modules whose lines pin the rules: imports, receivers, decorators, comments above, assigned names, HTTP verbs.
PY = """
SELECT CASE c_custkey % 13 WHEN 12 THEN 'build/m' ELSE 'svc/m' END || c_custkey || '.py' AS path, concat_ws(chr(10), 'import httpx',
  CASE c_custkey % 3 WHEN 0 THEN 'from redis import Redis' WHEN 1 THEN 'import pinecone' ELSE 'from langsmith import Client' END,
  CASE c_custkey % 3 WHEN 0 THEN 'store = Redis()' WHEN 1 THEN 'store = pinecone.Pinecone()' ELSE 'store = Client()' END,
  CASE c_custkey % 5 WHEN 0 THEN '@app.post("/x")' WHEN 1 THEN '@router.get("/y")' WHEN 2 THEN '@tool' WHEN 3 THEN '@shared_task' ELSE '@other.thing' END,
  CASE c_custkey % 2 WHEN 0 THEN 'async def run' ELSE 'def run' END || c_custkey || CASE c_custkey % 7 WHEN 0 THEN '(self, a, b=1):' WHEN 1 THEN '(a, *rest, c=2):' ELSE '(a):' END,
  CASE c_custkey % 4 WHEN 0 THEN '    # ask model ' || c_custkey WHEN 1 THEN '' WHEN 2 THEN '    #' ELSE '    pass' END,
  '    r = ' || CASE c_custkey % 2 WHEN 0 THEN 'await ' ELSE '' END || CASE c_custkey % 8 WHEN 0 THEN 'client.messages.create(model="m' || c_custkey || '")' WHEN 1 THEN 'llm.invoke(a)'
    WHEN 2 THEN 'emb.embed_query(a)' WHEN 3 THEN 'client.responses.create(model=name)' WHEN 4 THEN 'obj.generate_content(a)' WHEN 5 THEN 'mystream(a)' WHEN 6 THEN 'client.beta.chat.completions.create(model="g")' ELSE 'chain.stream(a)' END,
  CASE c_custkey % 5 WHEN 0 THEN '    store.set(a, r)' WHEN 1 THEN '    store.query(a)' WHEN 2 THEN '    self.store.upsert(a)' WHEN 3 THEN '    store.index.add(a)' ELSE '    store.other(a)' END,
  '    return ' || CASE c_custkey % 4 WHEN 0 THEN 'httpx.get("https://h/' || c_custkey || '")' WHEN 1 THEN 'requests.post(url)' WHEN 2 THEN 'httpx.options("https://h")' ELSE 'urllib.request(url="https://u")' END,
  CASE WHEN c_custkey % 3 = 1 THEN 'def handler(event, context):' ELSE 'def handler(event, other):' END, '    return 1',
  CASE WHEN c_custkey % 4 = 2 THEN 'if __name__ == "__main__":' ELSE 'if __name__ == "x":' END, '    go(1)', CASE WHEN c_custkey % 17 = 5 THEN 'def (' ELSE '# end' END) AS text
FROM customer
"""
MANIFESTS = """
SELECT CASE o_orderkey % 4 WHEN 0 THEN '.env' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'requirements.txt' ELSE 'notes.txt' END AS name, o_orderkey AS k,
  concat_ws(chr(10), CASE WHEN o_orderkey % 7 = 0 THEN 'ANTHROPIC_API_KEY=x' ELSE 'OPENAI_API_KEY=x' END, 'SERVICE_BASE_URL = "https://h' || o_orderkey || '.org/v1"', 'CACHE_TTL: ' || o_orderkey % 900, CASE WHEN o_orderkey % 3 = 0 THEN 'langchain-core==0.2' ELSE 'openai>=1' END, 'anthropic==0.3') AS text
FROM orders
"""
OPERATIONS = """
SELECT 'src/u' || (user_id % 50) || '.py' AS path, CAST(event_id % 40 + 1 AS INT) AS line,
  CASE event_id % 7 WHEN 0 THEN 'invoke_llm' WHEN 1 THEN 'embed' WHEN 2 THEN 'telemetry' WHEN 3 THEN 'vector_store_write' WHEN 4 THEN 'memory_persist' WHEN 5 THEN 'tool_call' ELSE 'external' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'langsmith' ELSE '' END AS provider
FROM events
"""
#: Repository addresses: names and spellings of internet addresses, ports, credentials, other schemes.
ADDRESSES = """
SELECT page_id, CASE page_id % 20 WHEN 0 THEN 'https://127.0.0.1/r' || page_id WHEN 1 THEN 'https://0x7f000001/r' WHEN 2 THEN 'https://2130706433/r' WHEN 3 THEN 'https://10.1/r' WHEN 4 THEN 'https://8.8.8.8/r'
  WHEN 5 THEN 'https://017700000001/r' WHEN 6 THEN 'https://192.168.1.' || page_id % 256 || ':8443/r' WHEN 7 THEN 'https://u@host.org/r' WHEN 8 THEN 'http://host.org/r' WHEN 9 THEN 'https://host' || page_id || '.org/r'
  WHEN 10 THEN 'https://172.' || page_id % 40 || '.0.1/r' WHEN 11 THEN 'https://1.2.3.4.5/r' WHEN 12 THEN 'https://169.254.1/r' WHEN 13 THEN 'https://0x08.010.8.8/r' WHEN 14 THEN 'https:///r'
  WHEN 15 THEN 'HTTPS://Host' || page_id || '.ORG/r' WHEN 16 THEN chr(9) || ' https://host.org/r ' || chr(10) WHEN 17 THEN 'https://host.org/a b' WHEN 18 THEN 'hTTps://0X7F.1/r' ELSE url END AS url
FROM pages
"""
#: What users may give as a threshold.
THRESHOLDS = """
SELECT event_id, CASE event_id % 14 WHEN 0 THEN 'none' WHEN 1 THEN ' High ' WHEN 2 THEN 'ALTO' WHEN 3 THEN 'critico' WHEN 4 THEN 'médio' WHEN 5 THEN 'medio' WHEN 6 THEN 'low' WHEN 7 THEN 'off' WHEN 8 THEN ''
  WHEN 9 THEN 'severe' WHEN 10 THEN 'Critical' WHEN 11 THEN 'baixo' WHEN 12 THEN 'nenhum' ELSE event_type END AS given
FROM events
"""
TABLES = ("orders", "customer", "events", "pages")

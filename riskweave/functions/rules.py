"""Fixed values of the scan: patterns, word lists and rule tables. Order inside a list is significant."""

from __future__ import annotations

# kind, Java pattern, has check digits, confidence
CANDIDATES = [
    ("cpf", r"(?U)(?<!\d)\d{3}\.?\d{3}\.?\d{3}-?\d{2}(?!\d)", True, 0.95),
    ("cnpj", r"(?U)(?<!\d)\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}(?!\d)", True, 0.95),
    ("cnh", r"(?U)(?<!\d)\d{11}(?!\d)", True, 0.85),
    ("titulo_eleitor", r"(?U)(?<!\d)\d{12}(?!\d)", True, 0.85),
    ("cep", r"(?U)(?<!\d)\d{5}-\d{3}(?!\d)", False, 0.7),
    ("email", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", False, 0.9),
    ("phone", r"(?U)\+?\d{2}\s?\(?\d{2}\)?\s?9?\d{4}-?\d{4}", False, 0.7),
]
KEYWORDS = {
    "cpf": ("cpf", "tax_id", "taxid", "documento"),
    "cnpj": ("cnpj", "tax_id", "taxid"),
    "cnh": ("cnh", "habilitacao", "habilitação", "driver_license", "drivers_license"),
    "titulo_eleitor": ("titulo", "título", "eleitor", "voter"),
    "pis": ("pis", "nis", "pasep"),
    "cep": ("cep", "zip", "postal", "endereco", "endereço", "address"),
    "email": ("email", "e-mail", "mail", "contato", "contact"),
    "phone": ("phone", "telefone", "celular", "mobile", "fone", "whatsapp"),
}
MARKERS = ("sample", "example", "exemplo", "fake", "dummy", "mock", "fixture", "placeholder")
TEST_PATH = r"(?:^|/)tests?(?:/|$)|(?:^|/)fixtures?(?:/|$)|(?:^|/)test_[^/]+\.(?:py|js|jsx|ts|tsx)$|_test\.(?:py|js|jsx|ts|tsx)$|\.spec\.(?:js|jsx|ts|tsx)$|\.test\.(?:js|jsx|ts|tsx)$|(?:^|/)conftest\.py$"
META_PATH = (
    r"(?:^|/)docs?(?:/|$)|(?:^|/)examples?(?:/|$)|(?:^|/)samples?(?:/|$)|(?:^|/)demos?(?:/|$)"
    r"|(?:^|/)setup\.(?:py|cfg)$|(?:^|/)pyproject\.toml$|(?:^|/)package\.json$"
)
META_NAME = r"(?i)(?:^|/)(?:README|LICENSE|CHANGELOG|CONTRIBUTING|CODE_OF_CONDUCT|SECURITY|AUTHORS|MAINTAINERS|HISTORY|NEWS|NOTICE)(?:\.[^/]*)?$"
REGEX_ARTIFACT = r"""\\d|\\\.|\[0-9\]|\br['"]"""
COMMENT_LINE = r"^\s*(?:#|//|/\*|\*)\s*(.+)$"
LINES_AROUND, MARKER_LINES = 5, 3

TEXT_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".md", ".yml", ".yaml", ".json", ".env", ".txt")
TEXT_NAMES = (".env", ".env.example")
TEXT_IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", "evals", "snapshots", "__snapshots__", "cassettes", "recordings", "coverage", "htmlcov")
PY_IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build")
JS_IGNORED = (*PY_IGNORED, ".next")
JS_SUFFIXES = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
CONFIG_NAMES = (".env", ".env.example", ".env.sample", "pyproject.toml", "requirements.txt", "requirements-dev.txt", "setup.py", "Pipfile", "Dockerfile", "package.json")

# Calls: suffix of the dotted name, kind, provider; the first that matches decides.
CALLS = [
    ("messages.create", "invoke_llm", "anthropic"),
    ("messages.stream", "invoke_llm", "anthropic"),
    ("chat.completions.create", "invoke_llm", "openai"),
    ("responses.create", "invoke_llm", "openai"),
    ("embeddings.create", "embed", "openai"),
    ("images.generate", "invoke_llm", "openai"),
    ("generate_content", "invoke_llm", "google"),
    ("embed_content", "embed", "google"),
    ("invoke", "invoke_llm", "langchain"),
    ("ainvoke", "invoke_llm", "langchain"),
    ("stream", "invoke_llm", "langchain"),
    ("astream", "invoke_llm", "langchain"),
    ("embed_query", "embed", "langchain"),
    ("embed_documents", "embed", "langchain"),
    ("aembed_query", "embed", "langchain"),
    ("aembed_documents", "embed", "langchain"),
]
DECORATORS = [(f"{owner}.{verb}", "fastapi") for owner in ("app", "router") for verb in ("post", "get", "put", "delete", "patch")] + [
    ("app.route", "flask"),
    ("app.command", "typer"),
    ("app.callback", "typer"),
    ("app.task", "celery"),
    ("shared_task", "celery"),
]
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "request")
HTTP_LIBRARIES = ("httpx", "requests", "urllib")
LIBRARY_SYMBOLS = {
    ("pinecone", "Pinecone"): ("vector_store_init", "pinecone"),
    ("weaviate", "Client"): ("vector_store_init", "weaviate"),
    ("qdrant_client", "QdrantClient"): ("vector_store_init", "qdrant"),
    ("chromadb", "Client"): ("vector_store_init", "chroma"),
    ("chromadb", "PersistentClient"): ("vector_store_init", "chroma"),
    ("faiss", "IndexFlatL2"): ("vector_store_init", "faiss"),
    ("faiss", "IndexFlatIP"): ("vector_store_init", "faiss"),
    ("redis", "Redis"): ("memory_persist", "redis"),
    ("redis", "StrictRedis"): ("memory_persist", "redis"),
    ("redis.asyncio", "Redis"): ("memory_persist", "redis_asyncio"),
    ("langchain.memory", "ConversationBufferMemory"): ("memory_persist", "langchain"),
    ("langchain_community.chat_message_histories", "RedisChatMessageHistory"): ("memory_persist", "langchain_redis"),
    ("langsmith", "Client"): ("telemetry", "langsmith"),
    ("langsmith.run_helpers", "traceable"): ("telemetry", "langsmith"),
    ("langfuse", "Langfuse"): ("telemetry", "langfuse"),
    ("langfuse.decorators", "observe"): ("telemetry", "langfuse"),
}
METHODS = {
    "upsert": "vector_store_write",
    "add": "vector_store_write",
    "query": "vector_store_read",
    "search": "vector_store_read",
    "hset": "memory_persist",
    "hget": "memory_persist",
    "set": "memory_persist",
}
# JavaScript and TypeScript
JS_PROVIDERS = [
    ("vercel_ai_sdk", r"""\bfrom\s+['"](ai|@ai-sdk/[^'"]+)['"]"""),
    ("anthropic", r"""\bfrom\s+['"]@anthropic-ai/sdk['"]"""),
    ("openai", r"""\bfrom\s+['"]openai['"]"""),
    ("google", r"""\bfrom\s+['"]@google/genai['"]"""),
]
JS_CALL = r"\b(generateText|streamText|generateObject|messages\.create|chat\.completions\.create|embed|embedMany|generate_content)\s*\("
JS_TOOL = r"\btool\s*\(\s*\{"
JS_HANDLER = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS)\s*\("
JS_ROUTE = r"""\bapp\.(get|post|put|patch|delete|use)\s*\(\s*['"]([^'"]+)['"]"""
JS_FUNCTION = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=|(?:async\s+)?(\w+)\s*\([^)]*\)\s*=>)"
# Frameworks, in order of their signatures; the first list wins over SDKs.
FRAMEWORKS_FIRST = ("langgraph", "crewai", "pydantic_ai", "langchain")
FRAMEWORKS = {
    "langgraph": (r"\bfrom\s+langgraph\b", r"\blanggraph\s*[=><~]"),
    "langchain": (r"\bfrom\s+langchain(?:_[a-z]+)?\b", r"\blangchain[-_]"),
    "crewai": (r"\bfrom\s+crewai\b", r"\bcrewai\s*[=><~]"),
    "pydantic_ai": (r"\bfrom\s+pydantic_ai\b",),
    "anthropic_sdk": (r"\bfrom\s+anthropic\b", r"^anthropic\s*[=><~]"),
    "openai_sdk": (r"\bfrom\s+openai\b", r"^openai\s*[=><~]"),
    "google_sdk": (r"\bfrom\s+google\.genai\b", r"\bgoogle-genai\b"),
}
PROVIDER_KEYS = [
    ("anthropic", r"^\s*ANTHROPIC_API_KEY"),
    ("openai", r"^\s*OPENAI_API_KEY"),
    ("google", r"^\s*(?:GOOGLE_API_KEY|GEMINI_API_KEY|GOOGLE_GENAI_API_KEY)"),
    ("azure_openai", r"^\s*AZURE_OPENAI"),
    ("mistral", r"^\s*MISTRAL_API_KEY"),
]
RETENTION = r"^\s*([A-Z0-9_]*(?:TTL|RETENTION|MAX_AGE|EXPIRE|EXPIRY|HISTORY_LIMIT)[A-Z0-9_]*)\s*[:=]\s*(\S+)"
BASE_URL = r"^\s*([A-Z0-9_]*(?:BASE_URL|ENDPOINT)[A-Z0-9_]*)\s*[:=]\s*(\S+)"

LEVELS = ("Baixo", "Médio", "Alto", "Crítico")
TREATMENT = {"Baixo": "aceitar", "Médio": "mitigar", "Alto": "mitigar", "Crítico": "evitar"}
ALIASES = {
    "none": None, "nenhum": None, "off": None, "baixo": "Baixo", "low": "Baixo", "medio": "Médio", "médio": "Médio", "medium": "Médio",
    "alto": "Alto", "high": "Alto", "critico": "Crítico", "crítico": "Crítico", "critical": "Crítico",
}
MOST_PROBABILITY_CUT, MOST_IMPACT_CUT = 2, 1
VECTOR_KINDS = ("vector_store_init", "vector_store_write", "vector_store_read")

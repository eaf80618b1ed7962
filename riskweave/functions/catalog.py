"""The catalog of data-protection risks: fixed identifiers, triggers and scores; the wording is this library's."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# id, category, description, articles, probability, impact, operations, flags, mitigations (text, probability cut, impact cut)
# fmt: off
ROWS = [
    ("AI-001", "confidencialidade", "Dados pessoais enviados a um modelo externo dentro do prompt", ["Art. 6º VII", "Art. 33-36", "Res. 19/2024"], 4, 4, ["invoke_llm", "embed"], ["external_provider"], [("Mascarar dados pessoais antes da chamada", 2, 0), ("Contrato de operador sem uso para treino", 1, 0), ("Cláusulas-padrão de transferência", 1, 0)]),
    ("AI-002", "confidencialidade", "Pessoas reconhecíveis a partir de vetores guardados", ["Art. 5º XI", "Art. 6º VII"], 3, 4, ["embed", "vector_store_write", "vector_store_init"], ["vector_store"], [("Pseudonimizar antes de vetorizar", 1, 1), ("Restringir o acesso ao índice", 1, 0)]),
    ("AI-003", "integridade", "Instruções injetadas que desviam o modelo", ["Art. 46", "Art. 47"], 4, 4, ["invoke_llm"], [], [("Filtrar entradas e saídas", 2, 0), ("Separar dados de instruções", 1, 1)]),
    ("AI-004", "direitos_do_titular", "Decisão automatizada que ninguém revisa", ["Art. 20", "Art. 18"], 3, 5, ["invoke_llm", "tool_call"], [], [("Revisão humana a pedido", 1, 2), ("Registro dos critérios", 1, 0)]),
    ("AI-005", "principios", "Tratamento discriminatório pelo modelo", ["Art. 6º IX"], 3, 4, ["invoke_llm"], [], [("Avaliar viés por grupo", 1, 1), ("Acompanhar resultados em produção", 1, 0)]),
    ("AI-006", "qualidade", "Resposta inventada que atinge o titular", ["Art. 6º V"], 4, 3, ["invoke_llm"], [], [("Ancorar respostas em fontes", 1, 1), ("Conferência antes do uso", 1, 1)]),
    ("AI-007", "transparencia", "Uso de IA sem aviso ao titular", ["Art. 6º VI", "Art. 9º", "Art. 20"], 4, 2, ["invoke_llm"], [], [("Aviso claro na interface", 2, 0), ("Descrição no aviso de privacidade", 1, 0)]),
    ("AI-008", "transferencia_internacional", "Envio de dados para fora do país sem mecanismo", ["Art. 33", "Art. 34", "Art. 35", "Art. 36", "Res. 19/2024"], 5, 3, [], ["external_provider"], [("Adotar mecanismo de transferência", 3, 0), ("Preferir região nacional", 1, 0)]),
    ("AI-009", "ciclo_de_vida", "Memória de conversa mantida além do necessário", ["Art. 15", "Art. 16", "Art. 6º III"], 4, 3, [], ["memory_store"], [("Prazo de expiração", 2, 0), ("Rotina de descarte", 1, 0)]),
    ("AI-010", "base_legal", "Dados aproveitados para treino sem base legal", ["Art. 7º", "Art. 11", "Art. 6º I"], 3, 4, [], ["external_provider"], [("Recusar o uso para treino", 2, 0), ("Anonimizar o que for reaproveitado", 1, 1)]),
    ("AI-011", "seguranca", "Dados pessoais em rastros de observabilidade", ["Art. 46"], 5, 3, [], ["telemetry"], [("Mascarar antes de registrar", 3, 0), ("Reter rastros por pouco tempo", 1, 1)]),
    ("AI-012", "controle", "Ferramenta que age em outros sistemas", ["Art. 46", "Art. 20"], 3, 4, ["tool_call"], [], [("Confirmação antes de agir", 1, 1), ("Lista de ações permitidas", 1, 0)]),
    ("AI-013", "confidencialidade", "Recuperação de dados usados no treino", ["Art. 46"], 2, 4, ["invoke_llm"], [], [("Limitar consultas repetidas", 1, 1), ("Treinar com dados reduzidos", 0, 1)]),
    ("AI-014", "governanca", "Suboperadores desconhecidos", ["Art. 39", "Art. 41"], 4, 2, [], ["external_provider"], [("Inventário de suboperadores", 2, 0)]),
    ("AI-015", "governanca", "Modelo sem versão registrada", ["Art. 6º V", "Art. 50"], 4, 2, ["invoke_llm"], [], [("Fixar e registrar a versão", 2, 0)]),
    ("AI-016", "direitos_do_titular", "Eliminação que não alcança vetores e memórias", ["Art. 18 IV", "Art. 18 VI", "Art. 16"], 4, 3, ["embed", "vector_store_write", "vector_store_init", "memory_persist"], ["vector_store"], [("Chave do titular em todo registro", 2, 0)]),
    ("AI-017", "populacoes_vulneraveis", "Menores sem verificação de idade", ["Art. 14"], 3, 5, ["invoke_llm"], [], [("Verificar idade e responsável", 1, 2)]),
    ("AI-018", "principios", "Dados sensíveis deduzidos pelo modelo", ["Art. 5º II", "Art. 11", "Art. 6º I"], 3, 4, ["invoke_llm"], [], [("Bloquear inferências sensíveis", 1, 1)]),
    ("CL-001", "confidencialidade", "Acesso por quem não deve", ["Art. 46"], 3, 4, [], ["always"], [("Autenticação forte e menor privilégio", 1, 1)]),
    ("CL-002", "integridade", "Dados alterados sem autorização", ["Art. 46"], 2, 4, [], ["always"], [("Trilhas de alteração", 1, 1)]),
    ("CL-003", "disponibilidade", "Dados perdidos ou fora do ar", ["Art. 46"], 3, 3, [], ["always"], [("Cópias testadas", 1, 1)]),
    ("CL-004", "confidencialidade", "Dados expostos a terceiros", ["Art. 46", "Art. 48"], 3, 5, [], ["always"], [("Criptografar em trânsito e em repouso", 1, 2), ("Detectar saídas anormais", 0, 1)]),
    ("CL-005", "minimizacao", "Coleta além do necessário", ["Art. 6º III"], 4, 2, [], ["pii"], [("Rever cada campo coletado", 2, 0)]),
    ("CL-006", "finalidade", "Uso para outro fim", ["Art. 6º I", "Art. 6º II"], 3, 3, [], ["always"], [("Registrar a finalidade", 1, 1)]),
    ("CL-007", "base_legal", "Tratamento sem hipótese legal", ["Art. 7º", "Art. 11"], 3, 4, [], ["pii"], [("Documentar a hipótese", 2, 0)]),
    ("CL-008", "direitos_do_titular", "Pedidos de titulares não atendidos", ["Art. 18"], 3, 3, [], ["always"], [("Canal e prazo de resposta", 1, 1)]),
    ("CL-009", "ciclo_de_vida", "Descarte que não acontece", ["Art. 15", "Art. 16"], 4, 2, [], ["pii"], [("Tabela de retenção", 2, 0)]),
    ("CL-010", "governanca", "Incidente comunicado tarde ou não comunicado", ["Art. 48", "Res. 15/2024"], 2, 4, [], ["always"], [("Plano de resposta a incidentes", 0, 2)]),
]
# fmt: on
SCHEMA = (
    "ord int, id string, categoria string, descricao string, artigos array<string>, p int, i int, operations array<string>, flags array<string>,"
    " mitigacoes array<struct<text: string, probability: int, impact: int>>"
)


NAMES = ("id", "categoria", "descricao", "artigos", "p", "i", "operations", "flags", "mitigacoes")


class CatalogError(ValueError):
    """A file that is no catalog of risks."""


def read_catalog(path: str) -> list[tuple]:
    """Rows of a catalog file that users can edit: a JSON list of objects with NAMES as keys.

    Lists may be left out; a mitigation is an object with text, probability and impact (cuts, 0 if left out).
    """
    try:
        entries = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise CatalogError(f"{path} can't be read as JSON") from e
    if not isinstance(entries, list):
        raise CatalogError(f"{path} holds no list")
    rows = []
    for n, entry in enumerate(entries, 1):
        missing = {"id", "categoria", "descricao", "p", "i"} - entry.keys() if isinstance(entry, dict) else {"everything"}
        if missing or entry.keys() - set(NAMES) or not all(isinstance(entry[k], int) and 1 <= entry[k] <= 5 for k in ("p", "i")):
            raise CatalogError(f"{path}, entry {n}: it needs id, categoria, descricao, and p and i from 1 to 5, and may have {', '.join(NAMES)}")
        steps = [(m["text"], int(m.get("probability", 0)), int(m.get("impact", 0))) for m in entry.get("mitigacoes", [])]
        lists = [list(map(str, entry.get(k, []))) for k in ("artigos", "operations", "flags")]
        rows.append((str(entry["id"]), entry["categoria"], entry["descricao"], lists[0], entry["p"], entry["i"], lists[1], lists[2], steps))
    return rows


def write_catalog(path: str, rows: list | None = None) -> None:
    """The catalog as a file to edit."""
    entries = [dict(zip(NAMES, row, strict=True)) for row in rows or ROWS]
    for entry in entries:
        entry["mitigacoes"] = [dict(zip(("text", "probability", "impact"), m, strict=True)) for m in entry["mitigacoes"]]
    Path(path).write_text(json.dumps(entries, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def risk_catalog(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """The catalog as a frame; ``ord`` keeps its order. 28 rows, so it may be broadcast."""
    return spark.createDataFrame([(n, *row) for n, row in enumerate(ROWS if rows is None else rows)], SCHEMA)

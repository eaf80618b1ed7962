"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

_NAMED = {
    "op1_substrings": "substrings",
    "op2_pieces": "pieces",
    "op3_jaccard": "jaccard",
    "op4_sharding": "sharding",
    "op5_language": "langid",
    "op6_quotes": "quotes",
    "op7_mixing": "mixing",
    "op8_quality": "quality",
    "op9_media": "media",
    "op10_licenses": "licenses",
    "op11_divergence": "divergence",
    "op12_simhash": "simhash",
    "op13_prefixes": "prefixes",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"riskweave.llm.{module}"), name) for name, module in _NAMED.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _NAMED.items():
        sql = getattr(importlib.import_module(f"riskweave.llm.{module}"), "ORACLE", None)
        if sql:
            found[name] = sql
    return found

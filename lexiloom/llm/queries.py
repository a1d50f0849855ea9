"""The registered queries ``opN_<name>`` and their SQL.

Each takes its rows from its operator and keeps the columns that its contract names.
"""

from __future__ import annotations

import importlib

#: Modules with QUERIES, and ORACLE_SQL where SQL expresses the result.
MODULES = (
    "q_quality_rules",
    "q_sharding",
    "q_mixing",
    "q_vector_dedup",
    "q_bwt_dedup",
    "q_ftrl",
    "q_secrets",
    "q_bpe",
    "q_line_dedup",
    "q_minhash",
)


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"lexiloom.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"lexiloom.llm.{name}"), "ORACLE_SQL", {})
    return found

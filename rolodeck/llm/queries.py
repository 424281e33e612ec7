"""The registered queries of the operators and their DuckDB oracles."""

from __future__ import annotations

import importlib

#: One module per operator, each with QUERIES (name to (spark, sf_dir) -> DataFrame) and ORACLE (name to SQL).
_MODULES = tuple(f"op{n}_queries" for n in range(1, 14))


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"rolodeck.llm.{m}").QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(importlib.import_module(f"rolodeck.llm.{m}").ORACLE)
    return out

"""All registered queries and their DuckDB oracles, merged per domain."""

from __future__ import annotations

import importlib

# Domain modules, each exporting QUERIES (name → (spark, sf_dir) → DataFrame)
# and ORACLE (name → DuckDB SQL over the raw tables).
_DOMAINS = ("metrics_plans", "listing_plans", "loadstats_plans", "import_plans", "changes_plans", "io_plans", "streaming_plans", "functions_plans")


def _modules():
    for name in _DOMAINS:
        yield importlib.import_module(f"rolodeck.plans.{name}")


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out

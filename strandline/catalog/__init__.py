"""Queries over the driver's tables with the SQL that says the same.

Every module has ``QUERIES`` (name -> callable of session and folder) and ``SQL`` (name -> DuckDB text).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("transforms", "comparisons", "rankings", "perturbations", "timelines", "files", "summaries", "places")


def collect() -> tuple[dict, dict[str, str]]:
    queries: dict = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql

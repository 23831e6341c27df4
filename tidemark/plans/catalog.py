"""All queries of the library with their SQL."""

from __future__ import annotations

from . import calls, changes, comparisons, extras, forecasts, lineage, mixed, series, sessions, stored, summaries, texts

MODULES = (sessions, comparisons, series, forecasts, texts, extras, calls, lineage, summaries, stored, mixed, changes)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

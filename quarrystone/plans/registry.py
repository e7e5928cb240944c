"""Registry of the catalog engine's queries and their oracle SQL."""

from __future__ import annotations

from . import catalog_queries, evaluation_queries, knowledge_queries, maintenance_queries, source_queries, text_queries

FLAGSHIP = "catalog_cell_fold"
_MODULES = (catalog_queries, evaluation_queries, knowledge_queries, maintenance_queries, source_queries, text_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}

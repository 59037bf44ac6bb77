"""All queries of the core, by name, and the SQL of those that a second engine can check."""

from __future__ import annotations

from . import data_queries, fixtures, reference_queries, snippets

_PARTS = (reference_queries, snippets, fixtures, data_queries)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

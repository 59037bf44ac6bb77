"""All queries of this subpackage."""

from __future__ import annotations

from . import data_queries


def queries() -> dict:
    return dict(data_queries.QUERIES)


def oracle_sql() -> dict:
    return dict(data_queries.ORACLES)

"""All registered queries of the core and their SQL."""

from __future__ import annotations

from webloom.plans import audit_queries, built_queries, general, index_queries, record_queries, url_queries

MODULES = [general, url_queries, record_queries, index_queries, audit_queries, built_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}

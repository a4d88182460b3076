"""The registered queries and their SQL."""

from __future__ import annotations

from weftline.plans import row_queries, search_queries, usage_queries

MODULES = (search_queries, row_queries, usage_queries)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

"""Every query of the engine by name, over the tables of a directory, with the SQL that checks it."""

from __future__ import annotations

from recordmill.plans import event_queries, graph_queries, jq_queries, search_queries, table_queries

MODULES = (search_queries, graph_queries, event_queries, jq_queries, table_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

"""All registered queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from tersloom.plans import compress_queries, log_queries, text_queries

_MODULES = (text_queries, compress_queries, log_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

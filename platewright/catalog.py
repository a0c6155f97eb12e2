"""Queries and SQL of the core."""

from __future__ import annotations

from platewright.plans import p1_queries, p6_queries, pipeline_queries, reference_queries, whole_queries

_MODULES = (p1_queries, p6_queries, reference_queries, pipeline_queries, whole_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}

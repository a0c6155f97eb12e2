"""Queries and SQL of this subpackage."""

from __future__ import annotations

import importlib

_MODULES = ("p2", "p3", "p4", "p5", "p7", "p8", "p9", "p10")


def _modules():
    for name in _MODULES:
        yield importlib.import_module(f"platewright.llm.{name}_queries")


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}

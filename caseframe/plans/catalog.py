"""All registered queries."""

from __future__ import annotations

import importlib

from caseframe.plans.registry import QUERIES, SQL, Query

_MODULES = (
    "inventory_queries",
    "known_queries",
    "log_queries",
    "source_queries",
    "search_queries",
    "recovery_queries",
    "report_queries",
)


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"caseframe.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)

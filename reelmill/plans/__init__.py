"""The registered queries of the library, each with the SQL it is held against."""

from __future__ import annotations

from importlib import import_module

from reelmill.plans.registry import ORACLE, QUERIES, Query

MODULES = ("evaluation", "timeline", "planning", "labels", "data", "protocol", "memory")


def queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"reelmill.plans.{name}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)

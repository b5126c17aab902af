"""Collects the query modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = (
    "scoring", "alerting", "suppression", "incidents", "listing", "dashboards", "deliveries", "features", "novelty",
    "intake",
)


class Plans:
    """Queries of one module: name, DataFrame function, optional SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def _all() -> list[Plans]:
    return [importlib.import_module(f"alertflow.plans.{m}").plans for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: v for p in _all() for k, v in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _all() for k, v in p.sql.items()}

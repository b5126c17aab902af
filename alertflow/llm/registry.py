"""Queries of the training-data operators and the SQL they must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("near_queries", "token_queries", "text_queries", "data_queries")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"alertflow.llm.{name}"), what)
    return found


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")

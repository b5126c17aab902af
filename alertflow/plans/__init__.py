"""Registered queries with the SQL they must agree with."""

from alertflow.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["base_queries", "us_queries", "decision_queries", "list_queries"]


def _collect(attribute: str) -> dict:
    out = {}
    for m in MODULES:
        out.update(getattr(import_module(f"veilwork.plans.{m}"), attribute))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")

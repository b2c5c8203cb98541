"""All core queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["problems", "logs", "vectors", "texts", "relations", "sources", "filters"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged |= getattr(import_module(f"tracelode.queries.{name}"), attribute, {})
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")

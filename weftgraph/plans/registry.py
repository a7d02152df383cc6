"""All queries of the core and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("instants", "structured", "graph", "exports", "text", "classify", "conversations", "vectors", "resolve", "temporal", "evaluation", "quality", "incremental", "lexical")


def _modules():
    return [import_module(f"weftgraph.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}

"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_queries", "p2_queries", "p3_queries", "p5_queries", "p6_queries", "p7_queries", "p8_queries", "p9_queries")

_loaded = [import_module(f"weftgraph.llm.{name}") for name in MODULES]
QUERIES = {name: fn for m in _loaded for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _loaded for name, sql in m.ORACLES.items()}

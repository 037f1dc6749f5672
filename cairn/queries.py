"""The registered core queries and their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> callable) and SQL (name -> text), in the order of registration.
MODULES = [
    f"cairn.operators.{m}"
    for m in ("incremental", "references", "bm25", "dense", "scoring", "graph", "textops", "records", "delta", "reports", "read", "interpret", "lookups")
] + ["cairn.plans.search"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(_name)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

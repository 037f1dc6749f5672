"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["vectors", "syntax", "chunking", "fusion", "docpairs", "packing", "leakage", "spans"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"cairn.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

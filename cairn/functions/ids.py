"""Canonical spellings of path-like identifiers and content hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(c: Column | str) -> Column:
    """One spelling for a path id: blanks around it, backslashes, doubled separators, `/./` and leading `./` removed.

    Case is kept. Null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(c, r"(/\.)+(?=/)", ""), r"^(\./)+", "")


def canonical_hash(c: Column | str) -> Column:
    """One rendering for a hash: blanks around it, an algorithm prefix (`sha256:`) and letter case removed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z0-9_.-]+:", ""))

"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ["lines", "quality", "mixing", "katz", "suffixes", "jaccard", "syncmers", "packing", "licenses", "surrogates"]


def collected() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"quakeweave.llm.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql

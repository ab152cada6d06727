"""Registered queries: operators wired to the given tables, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("profile_queries", "itemset_queries", "similarity_queries", "recommend_queries", "graph_queries", "text_queries")


def all_queries() -> dict:
    """Name -> (function of session and folder, SQL text or None)."""
    found: dict = {}
    for module in MODULES:
        found.update(importlib.import_module(f"reviewmine.plans.{module}").QUERIES)
    return found

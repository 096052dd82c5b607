"""All registered queries, by family."""

from __future__ import annotations

import importlib

FAMILIES = (
    "prices",
    "curves",
    "universe",
    "sources",
    "models",
    "research",
    "ledger",
    "streaming",
)


def all_queries() -> dict:
    merged: dict = {}
    for family in FAMILIES:
        for name, query in importlib.import_module(f"tidemark.plans.{family}_queries").QUERIES.items():
            assert name not in merged, name
            merged[name] = query
    return merged

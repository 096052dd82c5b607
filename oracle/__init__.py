"""DuckDB SQL with the same meaning as each registered query."""

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


def all_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for family in FAMILIES:
        for name, sql in importlib.import_module(f"oracle.{family}").SQL.items():
            assert name not in merged, name
            merged[name] = sql
    return merged

"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

_GROUPS = (
    "sources",
    "predicates",
    "joins",
    "aggregates",
    "windows",
    "sets",
    "scalars",
    "streams",
    "verification",
    "governance",
    "integrity",
)

for _group in _GROUPS:
    import_module(f"{__name__}.{_group}")

__all__ = ["QUERIES", "ORACLES"]

"""Operators bound to the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from kinolake.registry.base import ORACLES, QUERIES

MODULES = ("scalars", "signals", "motion", "catalog", "describe", "retrieval", "assembly", "timeline", "streams",
           "files")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"kinolake.registry.{name}")
    return QUERIES, ORACLES

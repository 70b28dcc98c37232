"""Registered queries over the benchmark tables with their DuckDB oracles."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = ("market", "valuation", "cleaning", "history", "ingest", "training")


def load() -> ModuleType:
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"pricelens.suite.{name}")
    return import_module("pricelens.suite.registry")

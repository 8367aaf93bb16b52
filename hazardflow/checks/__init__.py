"""Domain views over the provided test tables, and the queries that are compared with SQL."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = ["rows", "requests", "history", "monitoring", "streams", "modeling"]


def load() -> ModuleType:
    """Register all queries and return the registry."""
    for name in MODULES:
        import_module(f"hazardflow.checks.{name}")
    return import_module("hazardflow.checks.registry")

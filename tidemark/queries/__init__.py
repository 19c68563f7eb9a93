"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """``(queries, SQL)`` by name."""
    from tidemark.queries import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES

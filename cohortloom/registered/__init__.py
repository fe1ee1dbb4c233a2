"""Queries over the given tables, each with its SQL equivalent where one exists."""

from __future__ import annotations

from importlib import import_module

# Modules that register queries when imported.
_MODULES = ("cleaning", "profiling", "modelling", "curves", "lineage", "files")


def load():
    """(queries, SQL equivalents) of every registered module."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    from .base import ORACLES, QUERIES

    return QUERIES, ORACLES

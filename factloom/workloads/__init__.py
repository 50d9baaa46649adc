"""Queries over the provided tables, each with the SQL that states the same result."""

import importlib

# The modules that register queries.
MODULES = ("checks", "catalog", "mapping", "evolution", "upkeep", "mining", "imports")


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"factloom.workloads.{name}")
    return importlib.import_module("factloom.workloads.registry")

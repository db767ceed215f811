"""Registered queries over the driver tables, each with its SQL counterpart where SQL can say it."""

import importlib

MODULES = ["series_queries", "list_queries", "clean_queries", "vector_queries", "table_queries", "stream_queries"]


def load():
    """(queries, SQL counterparts) by name."""
    from outcry.plans import registry

    for name in MODULES:
        importlib.import_module(f"outcry.plans.{name}")
    return registry.QUERIES, registry.ORACLES

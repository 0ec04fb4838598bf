"""All runnable queries with their reference SQL."""

from importlib import import_module

TOPICS = ("sources", "clean", "joins", "aggregates", "windows", "sequences", "sampling", "metrics", "hooks")


def load_catalog():
    """(queries by name, SQL by name)."""
    for topic in TOPICS:
        import_module(f"pathloom.catalog.{topic}")
    registry = import_module("pathloom.catalog.registry")
    return registry.QUERIES, registry.ORACLES

"""Named queries: each module registers its own."""

from importlib import import_module

MODULES = ("task_queries", "corpus_queries", "graph_queries", "people_queries", "ops_queries", "stream_queries")


def load():
    """Import every query module and return the filled registry."""
    for name in MODULES:
        import_module(f"coord.plans.{name}")
    return import_module("coord.plans.registry")

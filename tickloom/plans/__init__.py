"""Named queries over the driver's tables."""

from importlib import import_module

MODULES = ["series_queries", "action_queries", "index_queries", "strategy_queries", "book_queries", "source_queries"]


def load_catalog() -> None:
    for name in MODULES:
        import_module(f"tickloom.plans.{name}")

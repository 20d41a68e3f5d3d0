"""Queries over the driver tables."""


def load_queries():
    """(queries, oracle SQL) of every query module."""
    from importlib import import_module
    from pkgutil import iter_modules

    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
    from .registry import QUERIES, oracle_texts

    return dict(QUERIES), oracle_texts()

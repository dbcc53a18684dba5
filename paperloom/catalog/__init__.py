"""Registered queries over the given tables, with their SQL oracles."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every query module, which registers its queries."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")

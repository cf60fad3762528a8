"""Check queries over the given tables, each next to the SQL it must agree with."""
from importlib import import_module

_MODULES = ["recon", "scalars", "rules", "files", "operations", "kpis", "incidents", "streams", "runs"]


def load():
    """Import every query module and return the registry."""
    for name in _MODULES:
        import_module(f"ledgerline.queries.{name}")
    return import_module("ledgerline.queries.base")

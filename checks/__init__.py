"""Registered queries: each pairs a Spark query with the SQL that must give the same rows."""
import importlib
import pkgutil


def load() -> None:
    """Import every module that registers queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")

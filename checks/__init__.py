"""Queries over the given tables, each with the SQL it is compared with."""

from importlib import import_module

MODULES = ("traffic", "series", "tables", "ingest")


def load_all() -> None:
    for module in MODULES:
        import_module(f"checks.{module}")

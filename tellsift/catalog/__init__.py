"""Registered queries, each with the SQL that gives the same rows where SQL can."""

from importlib import import_module

from tellsift.catalog.registry import ORACLE, QUERIES

MODULES = ["tables_q", "text_q", "model_q"]


def _load() -> None:
    for name in MODULES:
        import_module(f"tellsift.catalog.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(ORACLE)

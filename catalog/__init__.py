"""Registered queries: each pairs a millrace operator with the SQL that defines its result."""

from importlib import import_module

MODULES = ("interest", "ranking", "duplicates", "crawl", "layouts")


def _load():
    for name in MODULES:
        import_module(f"catalog.{name}")
    return import_module("catalog.registry")


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict:
    return dict(_load().SQL)

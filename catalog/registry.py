"""Registry of (Spark query, SQL) pairs."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from catalog.views import Views, with_views
from millrace.session import prepare, ship_package

_SHARED: dict[tuple[str, str], Views] = {}


def shared_views(spark: SparkSession, sf_dir: str) -> Views:
    """One Views per session and folder: derived tables are written once, as in production."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        ship_package(spark, str(Path(__file__).parent))
        _SHARED[key] = Views(prepare(spark), sf_dir)
    return _SHARED[key]


def forget_views() -> None:
    """Drop the shared derived tables (the benchmark times every query from the raw tables)."""
    _SHARED.clear()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``build(views) -> DataFrame`` under ``name``; ``sql`` may use the named views."""

    def wrap(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(shared_views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return build

    return wrap

"""The driver contract."""

import __spark_entry__ as entry_point
from catalog.registry import shared_views


def test_contract(spark):
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert len(queries) > 90 and set(sql) <= set(queries)
    assert entry_point.entry(spark).count() > 0


def test_derived_tables_are_shared(spark):
    assert shared_views(spark, entry_point.SMOKE_DIR) is shared_views(spark, entry_point.SMOKE_DIR)

"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from compare import connect, difference, spark_side, sql_side

from __spark_entry__ import entry, oracle_sql, queries
from assay.catalog.registry import REGISTRY

KEYS = [key for key in queries() if key in REGISTRY]  # the text-collection queries have tests of their own


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, small, con, key):
    df = queries()[key](spark, small)
    ours = spark_side(df)
    sql = oracle_sql().get(key)
    if sql is not None:
        assert difference(ours, sql_side(con, sql)) is None


def test_entry(spark):
    assert entry(spark).count() == 1

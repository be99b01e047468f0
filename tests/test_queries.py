"""Every query against its SQL, and every query without SQL for a stable result."""

from __future__ import annotations

import pytest
from compare import same_rows

from loomstone.plans import catalog, data_queries

QUERIES = {**catalog.QUERIES, **data_queries.QUERIES}
ORACLES = {**catalog.ORACLES, **data_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, data, duck, name):
    same_rows(QUERIES[name](spark, data), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

from __future__ import annotations

import pytest

from loomstone.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0


def test_columns(spark, data):
    want = {"p2_found": ["tbl", "row_key"], "p3_found": ["row_a", "row_b"], "p5_found": ["row_id", "field"], "p9_found": ["doc_id"]}
    assert {n: Q.QUERIES[n](spark, data).columns for n in want} == want

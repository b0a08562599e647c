"""Corpus queries that SQL can say, against it."""

import pytest
from oracle import expected, rows_of

from meridia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), expected(queries.ORACLES[name], sf)
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)

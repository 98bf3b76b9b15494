"""Queries of the training-data operators against their SQL on a whole small table."""

import pytest
from check_queries import compare, connect

from factorloom.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = connect(SMALL).execute(queries.ORACLES[name]).df()
    assert len(want) > 0
    assert compare(got, want) == ""

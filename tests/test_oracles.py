"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from catalog.check import connect, differences
from catalog.oracles import all_oracles
from catalog.queries import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    assert differences(spark, duck, SF, QUERIES[name], ORACLES[name]) == []

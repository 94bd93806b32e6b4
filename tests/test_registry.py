import pytest

from locavec import registry

from .oracle import compare, connect

QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 130


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).df()) is None

import pytest
from compare import duck, rows
from compare import DATA

from marlstone.plans import catalog_queries, queries as plans, store_queries

PARTS = (plans, catalog_queries, store_queries)
QUERIES, ORACLES = {k: f for p in PARTS for k, f in p.QUERIES.items()}, {k: f for p in PARTS for k, f in p.ORACLES.items()}


def test_every_query_has_sql_and_a_description():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) == sum(len(p.QUERIES) for p in PARTS)
    assert all(f.__doc__ for f in QUERIES.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck(ORACLES[name], DATA)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.queries().keys() >= QUERIES.keys()

"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from metrascope import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(agree, name):
    agree(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf, name):
    queries.QUERIES[name](spark, sf).collect()


def test_sql_names_are_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)

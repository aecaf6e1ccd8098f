import pytest

from tests.compare import same
from tilewise.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name])


#: Queries that SQL can't express, and the test that compares each with NumPy.
WITHOUT_SQL = {"low_rank_detector": "tests/test_training.py"}


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL) | set(WITHOUT_SQL)

import pytest

from tests.compare import same
from tilewise.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])

import pytest

from lumenfold.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")

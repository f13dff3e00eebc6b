import pytest

from lumenfold.plans import analogues, fact_queries, source_queries, world_queries  # noqa: F401  (the others add to the first's queries)
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(analogues.ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(spark, name, analogues.QUERIES[name], analogues.ORACLE_SQL[name], "/root/testdata/sf0.001")

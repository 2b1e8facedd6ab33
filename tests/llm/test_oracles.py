import pytest

from pagemill.llm.queries import ORACLE, QUERIES

from tests.llm.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLE[name], "/root/testdata/sf0.01")

import pytest

from pagemill.plans import pdf_queries, queries

from tests.oracle import same

QUERIES, ORACLE = queries.QUERIES | pdf_queries.QUERIES, queries.ORACLE | pdf_queries.ORACLE
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE[name], SF)

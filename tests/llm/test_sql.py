import pytest
from compare import compare

from veriform.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name]) is None

import os

import pytest
from oracle_check import compare, duck

from creditloom.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), SF, registry.QUERIES[name], registry.ORACLES[name]) == []

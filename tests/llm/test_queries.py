import pytest

from lodeframe.llm import queries
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, con, name):
    compare(queries.queries()[name](spark, SF), con, queries.ORACLE_SQL[name])

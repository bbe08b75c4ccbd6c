import pytest

from lodeframe.queries import ORACLE, QUERIES
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        compare(df, con, ORACLE[name])
    else:
        assert df.count() > 0

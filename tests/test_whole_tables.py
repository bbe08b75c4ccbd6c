"""The sort and null-safe join queries return all rows of a larger table, its nulls among them."""

import pytest

from lodeframe.queries import ORACLE, QUERIES
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.1"
NAMES = ["join_null_safe", *(f"sort_{way}_nulls_{end}" for way in ("asc", "desc") for end in ("first", "last"))]


@pytest.mark.parametrize("name", NAMES)
def test_all_rows_are_returned(spark, name):
    df = QUERIES[name](spark, SF)
    compare(df, connection(SF), ORACLE[name])
    got = df.agg({"*": "count", "v": "count"}).first()
    assert tuple(sorted(got)) == (10030, 20000)

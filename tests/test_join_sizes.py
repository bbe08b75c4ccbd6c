"""Joins of sides that are larger than they look."""

import pytest

from lodeframe.functions.expressions import Ref
from lodeframe.operators import joins
from lodeframe.operators.joins import join_frames


@pytest.mark.parametrize("hint", ["broadcast_left", "broadcast_right"])
def test_a_broadcast_is_bounded_by_its_rows_in_memory(spark, tmp_path, hint):
    """A compressed file of equal rows is small on disk only."""
    path = str(tmp_path / "rows")
    spark.range(1_000_000).selectExpr("id div 1000 AS k", "repeat('x', 20) AS x").coalesce(1).write.parquet(path)
    many, few = spark.read.parquet(path), spark.range(1, 3).selectExpr("id AS k", "'a' AS y")
    assert joins.measured_bytes(many) > joins.BROADCAST_LIMIT > int(many._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    left, right = (many, few) if hint == "broadcast_left" else (few, many)
    df = join_frames(left, right, Ref(0).eq(Ref(2)), hint=hint)
    assert df.count() == 2000
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    back = {"broadcast_left": "broadcast_right", "broadcast_right": "broadcast_left"}[hint]
    df = join_frames(left, right, Ref(0).eq(Ref(2)), hint=back)
    assert df.count() == 2000
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()

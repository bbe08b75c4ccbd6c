"""The check of the approximate distinct count keeps one sketch, not one for each key."""

from lodeframe.queries import QUERIES


def test_no_sketch_for_each_key(spark):
    df = QUERIES["agg_approx_distinct_close"](spark, "/root/testdata/sf0.01")
    assert [tuple(r) for r in df.collect()] == [(True,)]
    sketches = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "approx_count_distinct" in line]
    assert sketches and all("keys=[]" in line for line in sketches)

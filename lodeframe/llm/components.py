"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.scratch import cut, discard


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of bigint ids -> ``(node, component)`` with component the smallest id reachable.

    Only nodes with an edge to another node appear; self loops and repeated edges are harmless, an
    edge with a null end is ignored, an empty table gives an empty table. Each round is a written
    table in the shared folder, so a lost executor costs one round at most. The rounds needed grow
    with the logarithm of the longest path.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    stars = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(stars)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(centre, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = cut(small.unionByName(centre.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = _signature(nxt)
        discard(stars)
        stars = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import topk

SF = "/root/testdata/sf0.001"


def brute(rows, every=50, k=5):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ints:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ints if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def got(df, every=50, **options):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, **options).drop("q_row").collect())


def test_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("block,head", [(64, 2), (8192, 3), (37, 8)])
def test_ties_copies_and_wide_norms(spark, block, head):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * 3 ** rng.randint(-3, 3) for _ in range(8)]) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(300)] + [(900 + i, [0.0] * 8) for i in range(20)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).repartition(4)
    assert got(df, block=block, head=head, queries=7) == brute(rows)


def test_few_and_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [])]
    df = spark.createDataFrame(rows, schema)
    assert got(df) == [(0, 1, 2, 0), (0, 2, 1, 256 * 128 - 512 * 256)]
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 0")) == []
    big = spark.createDataFrame([(0, [3e5, 1.0]), (1, [2e5, 1.0]), (2, [1e5, 7.0])], "vec_id bigint, embedding array<double>")
    assert got(big) == brute([(r.vec_id, r.embedding) for r in big.collect()])


def test_scores_beyond_what_doubles_hold(spark):
    rng = random.Random(6)
    schema = "vec_id bigint, embedding array<double>"
    # about 2^54: past what doubles tell apart, within 64 bits
    rows = [(i, [rng.choice((-1, 1)) * (2.0**18 + rng.randrange(1 << 10) / 256) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, schema)
    assert got(df, block=50, queries=3) == brute(rows)
    near = [(0, [2.0**23, 1.0]), (1, [2.0**22, 1.0]), (2, [2.0**22, 3.0]), (3, [-(2.0**22), 5.0])]
    assert got(spark.createDataFrame(near, schema)) == brute(near)
    for wrong, what in (([(0, [1e15, 1.0]), (1, [1e15, 1.0])], "64 bits"), ([(0, [1e18]), (1, [1.0])], "64 bits")):
        with pytest.raises(Exception, match=what):
            got(spark.createDataFrame(wrong, schema))


def test_repeated_ids_answer_by_themselves(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(50, [rng.gauss(0, 1) for _ in range(6)]) for _ in range(3)] + [(7, [3.0] * 6)] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, block=16, queries=2).collect()
    by = {}
    for r in found:
        by.setdefault((r.query_id, r.q_row), []).append((r["rank"], r.vec_id, r.score))
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, a in ints:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ints if c != q)[:5]
            want.append((q, [(n + 1, c, -s) for n, (s, c) in enumerate(scored)]))
    assert sorted((q, sorted(v)) for (q, _), v in by.items()) == sorted(want) and len(by) == 6


def test_bounds_spare_blocks_of_equal_norms(spark):
    """Unit vectors in separate directions: norms tell nothing, the ranges of rotated coordinates do."""
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    rows = []
    for i in range(2000):
        v = centres[i // 250] + rng.normal(0, 0.02, 8)
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
    ints = np.array([[math.floor(256 * x) for x in v] for _, v in rows])
    rotation = np.linalg.eigh(ints.T @ ints)[1][:, ::-1]

    class Held:
        def __init__(self, value):
            self.value = value

    pack = topk._pack(8, 250, Held(rotation), 8)
    blocks = list(pack([pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(ints.tolist())], names=["id", "x"])]))
    assert len(blocks) == 8
    norms = np.array([b.column(0)[0].as_py() for b in blocks])
    bounds = np.array([np.frombuffer(b.column(2)[0].as_py()) for b in blocks])
    first = [blocks[0].column(c)[0].as_py() for c in (3, 4)]
    bars = topk._bars(Held(rotation), Held((np.arange(8), norms, bounds, first)), 8, 5, 8)
    q = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([[0, 1]]), pa.array([[0, 50]]), pa.array([ints[[0, 50]].tolist()])], names=list("abcd"))
    out = next(iter(bars([q])))
    assert out.column(5)[0].as_py() == [0]  # of 8 blocks, only their own
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(df, block=100, queries=5) == brute(rows)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        topk.top_k(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))

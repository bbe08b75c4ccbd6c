"""Exact top-k by inner product: blocks in order of falling norm, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodeframe.llm.scratch import cut, small_batches

#: Vectors of a candidate block, and queries of a group; a task holds one of each.
BLOCK, QUERIES = 2048, 4096
#: Candidate blocks, about, at most: beyond it blocks grow, so that the list of their bounds stays small: a broadcast of
#: 8 * (2 * head + 3) bytes for each, 18 MB with 16 head coordinates.
MOST_BLOCKS = 1 << 16
#: Candidates that share one bound check.
_STEP = 1024
_EXACT, _LONG = float(1 << 53), 1 << 63


def _matrix(col, dim: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones are padded with zeros."""
    out = np.zeros((len(col), dim), np.int64)
    for i, x in enumerate(col):
        v = x.values.to_numpy(zero_copy_only=False)
        out[i, : len(v)] = v
    return out


def _gram(dim: int):
    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim).astype(np.float64)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(g), pa.list_(pa.float64()))], names=["row", "g"])

    return run


def _pack(dim: int, size: int, rotation, head: int):
    """Rows of a partition, already in order of falling norm, to blocks, each with what bounds its scores: the largest norm,
    the range of each of the first ``head`` rotated coordinates, and the largest norm of the rest."""

    def block(ids, x):
        r = x.astype(np.float64) @ rotation.value
        bound = np.concatenate([r[:, :head].min(0), r[:, :head].max(0), [_norms(r[:, head:]).max()]])
        columns = [pa.array([float(_norms(x.astype(np.float64)).max())]), pa.array([len(ids)]), pa.array([bound.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["norm", "n", "bound", "ids", "x"])

    def run(batches):
        ids, xs = np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
        for b in batches:
            ids = np.concatenate([ids, b.column(0).to_numpy(zero_copy_only=False)])
            xs = np.concatenate([xs, _matrix(b.column(1), dim)])
            while len(ids) >= size:
                yield block(ids[:size], xs[:size])
                ids, xs = ids[size:], xs[size:]
        if len(ids):
            yield block(ids, xs)

    return run


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


_NOTHING, _GONE = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def _multiply(q, c, may):
    return q @ c.T


def _multiply_checked(q, c, may):
    """Inner products that may leave 64 bits, exactly; those of pairs that count must not."""
    s = q.astype(object) @ c.T.astype(object)
    if any(not -_LONG + 1 < v < _LONG for v in s[may]):
        raise OverflowError("an inner product leaves 64 bits")
    return np.where(may, s, 0).astype(np.int64)


def best(q_ids, q, c_ids, c, rotation, k: int, head: int, low=None, top=None):
    """(scores, ids) by query of the ``k`` best candidates, ties to smaller ids; fewer are filled up with _NOTHING.

    Candidates come in steps of falling norm. A query stops at the first step whose largest norm times
    its own cannot reach its k-th score; within a step, the first ``head`` rotated coordinates plus the
    product of the residual norms bound each score, and only pairs that can still get in are computed.
    ``low``: scores that each query is known to reach. ``top``: (scores, ids) of candidates seen before,
    which take part.
    """
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    order = np.lexsort((c_ids, -_norms(cf)))
    c_ids, cf = c_ids[order], cf[order]
    limit = np.abs(qf).max(initial=0) * np.abs(cf).max(initial=0) * max(1, q.shape[1])
    exact = limit < _EXACT
    ci = None if exact else c[order]
    multiply = _multiply if limit < _LONG / 2 else _multiply_checked
    qr, cr = qf @ rotation, cf @ rotation
    q_norm, c_norm = _norms(qf), _norms(cf)
    q_rest, c_rest = _norms(qr[:, head:]), _norms(cr[:, head:])
    slack = 1e-9 * (1 + q_norm * c_norm.max(initial=0))
    bar = np.full(len(q), -np.inf) if low is None else low.astype(np.float64).copy()
    lead = 8 * k
    top_s, top_i = (np.full((len(q), 0), 0, np.int64), np.zeros((len(q), 0), np.int64)) if top is None else top
    nothing, gone = _NOTHING, _GONE
    edges = [0, min(lead, len(c_ids)), *range(_STEP, len(c_ids) + _STEP, _STEP)]
    for a, z in zip(edges, edges[1:], strict=False):
        z = min(z, len(c_ids))
        if a >= z:
            continue
        live = np.flatnonzero(q_norm * c_norm[a] + slack >= bar)
        if not len(live):
            break
        may = qr[live, :head] @ cr[a:z, :head].T + q_rest[live, None] * c_rest[None, a:z] + slack[live, None] >= bar[live, None]
        may &= q_ids[live, None] != c_ids[None, a:z]
        rows = np.flatnonzero(may.any(1))
        if not len(rows):
            continue
        live, may = live[rows], may[rows]
        cols = np.flatnonzero(may.any(0))
        may = may[:, cols]
        if exact:
            s = np.rint(qf[live] @ cf[a + cols].T).astype(np.int64)
        else:
            s = multiply(q[live], ci[a + cols], may)
        s = np.where(may, s, nothing)
        ids = np.where(may, c_ids[a + cols][None, :], gone)
        old_s = np.full((len(q), 0), nothing) if not top_s.shape[1] else top_s
        both_s = np.concatenate([old_s[live], s], 1)
        both_i = np.concatenate([top_i[live], ids], 1)
        # the k best by score, then id: cut to what reaches the k-th score before ordering fully
        pick = np.lexsort((both_i, -both_s), axis=1)[:, :k] if both_s.shape[1] <= 4 * k else _cut(both_s, both_i, k)
        new_s, new_i = np.take_along_axis(both_s, pick, 1), np.take_along_axis(both_i, pick, 1)
        if new_s.shape[1] < k:
            pad = k - new_s.shape[1]
            new_s = np.pad(new_s, ((0, 0), (0, pad)), constant_values=nothing)
            new_i = np.pad(new_i, ((0, 0), (0, pad)), constant_values=gone)
        if not top_s.shape[1]:
            top_s, top_i = np.full((len(q), k), nothing), np.full((len(q), k), gone)
        top_s[live], top_i[live] = new_s, new_i
        full = new_s[:, k - 1] > nothing
        bar[live[full]] = np.maximum(bar[live[full]], new_s[full, k - 1])
    return (top_s, top_i) if top_s.shape[1] else (np.full((len(q), k), nothing), np.full((len(q), k), gone))


def _cut(s, ids, k: int):
    """Columns of the k largest by (score, -id) in each row: a partial selection, then ties at the edge."""
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(s), k), np.int64)
    for r in range(len(s)):
        at = np.flatnonzero(s[r] >= kth[r])
        out[r] = at[np.lexsort((ids[r, at], -s[r, at]))[:k]]
    return out


def _packed(ids, x) -> tuple[bytes, bytes]:
    return ids.tobytes(), x.tobytes()


def _unpacked(ids: bytes, x: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(x, np.int64).reshape(-1, dim)


def _bars(rotation, summary, dim: int, k: int, head: int):
    """Each group of queries, packed, with the k-th scores that its queries reach in the first block alone, and the blocks
    that may hold a better candidate for any of them."""

    def run(batches):
        r, (numbers, norms, bounds, first) = rotation.value, summary.value
        c_ids, c = _unpacked(*first, dim)
        low_edge, high_edge, rest = bounds[:, :head], bounds[:, head : 2 * head], bounds[:, 2 * head]
        for b in batches:
            for qg, rows, ids, xs in zip(*(b.column(j) for j in range(4)), strict=True):
                q_ids, q, row_ids = ids.values.to_numpy(zero_copy_only=False), _matrix(xs.values, dim), rows.values.to_numpy(zero_copy_only=False)
                top_s, _ = best(q_ids, q, c_ids, c, r, k, head)
                bar = top_s[:, k - 1]
                qf = q.astype(np.float64)
                q_norm, qr = _norms(qf), qf @ r
                q_rest = _norms(qr[:, head:])
                meets = []
                for a in range(0, len(numbers), 256):
                    # the most that a candidate of the block can score: by its norm, and by its box of head coordinates
                    most = q_norm[:, None] * norms[None, a : a + 256]
                    box = np.maximum(qr[:, :head], 0) @ high_edge[a : a + 256].T + np.minimum(qr[:, :head], 0) @ low_edge[a : a + 256].T
                    most = np.minimum(most, box + q_rest[:, None] * rest[None, a : a + 256])
                    may = most + 1e-9 * (1 + q_norm[:, None] * norms[None, a : a + 256]) >= np.where(bar > _NOTHING, bar, -np.inf)[:, None]
                    meets.append(numbers[a : a + 256][may.any(0)])
                out = (qg.as_py(), row_ids.tobytes(), *_packed(q_ids, q), bar.tobytes(), np.concatenate(meets).tolist() if meets else [])
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], names=["qg", "q_rows", "q_ids", "q_x", "low", "meets"])

    return run


def _search(rotation, dim: int, k: int, head: int):
    """A partition's cells, one after another: first the group of queries, then its blocks one by one, with the best
    scores so far; only one group and one block are held."""

    def done(group):
        rows, q_ids, _, _, top = group
        if top is not None:
            row, col = np.nonzero(top[0] > _NOTHING)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(rows[row]), pa.array(q_ids[row]), pa.array(top[1][row, col]), pa.array(top[0][row, col])], names=["q_row", "query_id", "vec_id", "score"])

    def run(batches):
        r, group = rotation.value, None
        for b in batches:
            for kind, rows, ids, xs, low in zip(*(b.column(j) for j in range(1, 6)), strict=True):
                if kind.as_py() == 0:
                    if group is not None:
                        yield from done(group)
                    q_ids, q = _unpacked(ids.as_py(), xs.as_py(), dim)
                    bar = np.frombuffer(low.as_py(), np.int64)
                    group = [np.frombuffer(rows.as_py(), np.int64), q_ids, q, np.where(bar > _NOTHING, bar.astype(np.float64), -np.inf), None]
                else:
                    c_ids, c = _unpacked(ids.as_py(), xs.as_py(), dim)
                    _, q_ids, q, bar, top = group
                    top = best(q_ids, q, c_ids, c, r, k, head, bar, top)
                    kth = top[0][:, k - 1]
                    group[3:] = [np.where(kth > _NOTHING, np.maximum(bar, kth), bar), top]
        if group is not None:
            yield from done(group)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, head: int | None = None, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score, q_row``: the ``k`` largest inner products of each query with all rows but
    its own, over components floor(scale * x); ties to the smaller id.

    Rows whose vector (or id) is null, or holds a null or non-finite component, take no part; empty
    vectors count as zero vectors, and of two lengths the shorter is padded with zeros. Of rows that repeat an id each takes part
    as a candidate and answers as a query of its own (``q_row`` tells them apart), but never against its own id.
    Scores are exact; a component or a score that leaves 64 bits raises. Ids must be integers. An empty table gives an empty result; other
    columns are not read.

    Candidates are range-partitioned by falling norm (then id, so equal norms spread) and packed in
    blocks. The block of the largest norms gives each query a first bound; a group of queries then meets
    only those blocks whose largest norm, and range of rotated partial sums plus residual norms, can still beat it,
    and prunes inside. Groups and blocks meet in the cells of a grid: a group is sent once to each column and a block
    once to each group that it may matter to; a task takes its blocks in order of falling norm and raises its bars as it goes.
    Every pair that could rank is computed.
    """
    spark = vectors.sparkSession
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise TypeError("ids must be integers")
    x = F.col(vec_col)
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    whole = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < float(_LONG), F.floor(scaled(v))).otherwise(F.raise_error(F.lit("a component leaves 64 bits")).cast("bigint")))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("x"), is_query.alias("q"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))), "vectors")
    dim, total, asked = rows.agg(F.max(F.size("x")), F.count(F.lit(1)), F.count_if("q")).first()
    if not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint, q_row bigint")
    dim = max(1, dim)
    head = head or max(1, min(16, dim // 4))
    parts = rows.select("x").mapInArrow(_gram(dim), "row int, g array<double>")
    sums = parts.select("row", F.posexplode("g").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((dim, dim))
    gram[sums["row"], sums["col"]] = sums["v"]
    rotation = spark.sparkContext.broadcast(np.linalg.eigh(gram)[1][:, ::-1].copy())

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(block, -(-total // MOST_BLOCKS))
    ordered = rows.repartitionByRange(n, F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id")
    # each partition may end in a small block of its own, so there are MOST_BLOCKS and n at most
    blocks = cut(ordered.select("id", "x").mapInArrow(_pack(dim, block, rotation, head), "norm double, n bigint, bound binary, ids binary, x binary").withColumn("cb", F.monotonically_increasing_id()), "blocks")
    listed = blocks.select("cb", "norm", "bound").orderBy(F.desc("norm"), "cb").collect()
    first = blocks.where(F.col("cb") == listed[0].cb).select("ids", "x").first()  # ``block`` vectors
    summary = spark.sparkContext.broadcast((np.array([r.cb for r in listed]), np.array([r.norm for r in listed]), np.array([np.frombuffer(r.bound) for r in listed]), (bytes(first.ids), bytes(first.x))))
    m = max(1, -(-asked // queries))
    grouped = rows.where("q").select(F.pmod(F.xxhash64("row"), F.lit(m)).alias("qg"), "row", "id", "x").groupBy("qg")
    grouped = grouped.agg(F.collect_list("row").alias("rows"), F.collect_list("id").alias("ids"), F.collect_list("x").alias("xs"))
    with small_batches(spark, 8):
        groups = cut(grouped.mapInArrow(_bars(rotation, summary, dim, k, head), "qg bigint, q_rows binary, q_ids binary, q_x binary, low binary, meets array<bigint>"), "queries")
        columns = max(1, min(len(listed), -(-2 * n // m)))
        cell = lambda c: F.col("qg") * columns + c
        asking = groups.select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"), "qg", "q_rows", "q_ids", "q_x", "low").select(cell(F.col("c")).alias("cell"), F.lit(0).alias("kind"), F.col("q_rows").alias("rows"), F.col("q_ids").alias("ids"), F.col("q_x").alias("x"), "low", F.lit(None).cast("double").alias("norm"))
        pairs = groups.select("qg", F.explode("meets").alias("cb"))
        offered = pairs.join(blocks.select("cb", "norm", "ids", "x"), "cb").select(cell(F.pmod(F.xxhash64("cb"), F.lit(columns))).alias("cell"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("rows"), "ids", "x", F.lit(None).cast("binary").alias("low"), "norm")
        cells = asking.unionByName(offered).repartition(n, "cell").sortWithinPartitions("cell", "kind", F.desc("norm"))
        found = cut(cells.select("cell", "kind", "rows", "ids", "x", "low").mapInArrow(_search(rotation, dim, k, head), "q_row bigint, query_id bigint, vec_id bigint, score bigint"), "found")
    ranked = found.selectExpr("query_id", "vec_id", "score", "q_row", "row_number() over (partition by q_row order by score desc, vec_id) as rank")
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "q_row")

"""Topics of texts, for tables that have none: clusters of normalised TF-IDF vectors of hashed words, learnt from every text."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.hashing import distinct_word_hashes as word_hashes
from lodeframe.llm.scratch import cut, discard, merged, small_batches

DIM = 1 << 11
#: Clusters at most, and passes that settle each level of splits.
TOPICS, ROUNDS = 8, 3
NONE = "none"
_STEP = 1 << 16
#: A bucket that a text has, and log(1 + how often).
_ENTRY = np.dtype([("at", "<u2"), ("v", "<f4")])
#: Sums are of multiples of 1 / _GRID, so they are exact and the same at any partitioning.
_GRID = float(1 << 20)


def counts(text: str | None) -> tuple[np.ndarray, int]:
    """How often words fall in each bucket, and how many words there are."""
    words = (text or "").encode().split()  # only \x20 and \x09-\x0D split
    total = np.zeros(DIM, np.int64)
    for at in range(0, len(words), _STEP):
        total += np.bincount((word_hashes(words[at : at + _STEP]) >> np.uint64(20)).astype(np.int64) & (DIM - 1), minlength=DIM)
    return total, len(words)


@dataclass
class Model:
    """Unit centroids by row, and the IDF of each bucket."""

    centroids: np.ndarray
    idf: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _chunks(column, size: int = 256):
    """The entries of a column of vectors, some rows at a time: where they start, each entry's row, buckets and values."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    for a in range(0, len(column), size):
        own = ends[a : a + size + 1]
        e = np.frombuffer(column.buffers()[2], _ENTRY, (own[-1] - own[0]) // _ENTRY.itemsize, own[0])
        sizes = np.diff(own) // _ENTRY.itemsize
        yield np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), e["at"].astype(np.int64), e["v"]


def _dense(starts: np.ndarray, row: np.ndarray, at: np.ndarray, v: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors by row, and their entries."""
    v = v * idf[at]
    v = v / np.sqrt(np.add.reduceat(v * v, starts))[row]
    x = np.zeros((len(starts), DIM), np.float32)
    x[row, at] = v
    return x, v


def _count(at: int):
    def run(batches):
        for b in batches:
            words, vec = np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for k, t in enumerate(b.column(at)):
                c, words[k] = counts(t.as_py())
                if words[k]:
                    has = np.flatnonzero(c > 0)
                    e = np.empty(len(has), _ENTRY)
                    e["at"], e["v"] = has, np.log1p(c[has])
                    vec[k] = e.tobytes()
            kept = [k for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(words), pa.array(vec, pa.binary())], names=[*(b.schema.names[k] for k in kept), "n_tokens", "_vec"])

    return run


def counted(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with a hash of the text, its number of words and its vector (null for a null text or one without
    words) in place of the text."""
    src = rows.select("*", F.xxhash64(F.col(text_col), F.lit(23)).alias("_h"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != text_col)
    return src.mapInArrow(_count(src.columns.index(text_col)), f"{kept}, n_tokens bigint, _vec binary")


def _summed(texts: DataFrame, run, size: int) -> np.ndarray:
    """The sum over all tasks of the ``size`` numbers that ``run`` gives for each, added up in a few tasks first."""
    with small_batches(texts.sparkSession, 2048):
        parts = texts.select("_vec").mapInArrow(run, "sums binary").repartition(4).mapInArrow(merged, "sums binary").collect()
    return sum((np.frombuffer(r.sums) for r in parts), np.zeros(size))


def _holders(batches):
    total = np.zeros(1 + DIM)
    for b in batches:
        for starts, _, at, _ in _chunks(b.column(0)):
            total[0] += len(starts)
            total[1:] += np.bincount(at, minlength=DIM)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _sides(shared):
    """For both sides of each split that is tried: its texts, and by bucket the sums of their values and, if asked for, of the squares."""

    def run(batches):
        idf, vectors, splits, tried, squares = shared.value
        cells = 2 * len(tried)
        total = np.zeros((cells, 1 + 2 * DIM))
        for b in batches:
            for starts, row, at, v in _chunks(b.column(0)):
                x, v = _dense(starts, row, at, v, idf)
                near, leaf, cell = x @ vectors.T, np.zeros(len(x), np.int64), np.full(len(x), -1)
                for k, (own, new) in enumerate(splits):
                    leaf[(leaf == own) & (near[:, 2 * k + 1] > near[:, 2 * k])] = new
                for k, (own, bucket, over) in enumerate(tried):
                    i = 2 * (len(splits) + k)
                    side = x[:, bucket] > over if bucket is not None else near[:, i + 1] > near[:, i]
                    cell = np.where(leaf == own, 2 * k + side, cell)
                place, q = cell[row] * DIM + at, np.rint(v * np.float32(_GRID)) / _GRID
                if cell.min() < 0:
                    place, q = place[place >= 0], q[place >= 0]
                total[:, 0] += np.bincount(cell[cell >= 0], minlength=cells)
                total[:, 1 : 1 + DIM] += np.bincount(place, q, cells * DIM).reshape(cells, DIM)
                if squares:
                    total[:, 1 + DIM :] += np.bincount(place, q * q, cells * DIM).reshape(cells, DIM)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def fit_counted(rows: DataFrame, topics: int = TOPICS, least: float = 0.02, rounds: int = ROUNDS) -> Model | None:
    """Clusters of all different texts of ``counted`` rows, each text once: up to ``topics``, none of fewer than ``least`` of the texts.
    None if there is no text with words.

    The largest clusters are split in two, until there are enough: first at the mean of the bucket that varies most within, then
    by the nearer of the sides' centroids, in ``rounds`` passes. Every pass reads all texts' vectors; only
    sums by cluster come to the driver.
    """
    spark = rows.sparkSession
    texts = cut(rows.where("_vec IS NOT NULL").select("_h", "_vec").distinct(), "topics")
    n, *df = _summed(texts, _holders, 1 + DIM)
    if not n:
        discard(texts)
        return None
    idf = np.log((1 + n) / (1 + np.array(df))).astype(np.float32) + np.float32(0.1)
    splits, fixed = [], np.zeros((0, DIM), np.float32)

    def passed(tried: list, vectors: np.ndarray, squares: bool = False) -> np.ndarray:
        shared = spark.sparkContext.broadcast((idf, np.concatenate([fixed, vectors]), splits, tried, squares))
        sums = _summed(texts, _sides(shared), 2 * len(tried) * (1 + 2 * DIM))
        shared.destroy()
        return sums.reshape(2 * len(tried), 1 + 2 * DIM)

    leaves = [passed([(0, 0, math.inf)], np.zeros((2, DIM), np.float32), True)[0]]
    left = {0}  # those that may be split
    while left and len(leaves) < topics:
        own = sorted(left, key=lambda k: (-leaves[k][0], k))[: topics - len(leaves)]
        tried = []
        for k in own:
            mean, square = leaves[k][1 : 1 + DIM] / leaves[k][0], leaves[k][1 + DIM :] / leaves[k][0]
            bucket = int(np.argmax(square - mean * mean))
            tried.append((k, bucket, float(mean[bucket])))
        sums = passed(tried, np.zeros((2 * len(own), DIM), np.float32))
        tried = [(k, None, 0.0) for k in own]
        for turn in range(rounds):
            centres = _unit(sums[:, 1 : 1 + DIM]).astype(np.float32)
            sums = passed(tried, centres, turn == rounds - 1)
        for i, k in enumerate(own):
            two = sums[2 * i : 2 * i + 2]
            if two[:, 0].min() < max(1, least * n):
                left.remove(k)  # what would split off is too small
                continue
            splits.append((k, len(leaves)))
            fixed = np.concatenate([fixed, centres[2 * i : 2 * i + 2]])
            left.add(len(leaves))
            leaves[k] = two[0]
            leaves.append(two[1])
    discard(texts)
    return Model(_unit(np.array(leaves)[:, 1 : 1 + DIM]).astype(np.float32), idf)


def fit(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> Model | None:
    """``fit_counted`` of texts."""
    with small_batches(docs.sparkSession):
        rows = cut(counted(docs.select(F.col(text_col).alias("text"))), "words")
    model = fit_counted(rows, topics)
    discard(rows)
    return model


def _place(shared, kept: list[str]):
    def run(batches):
        m: Model | None = shared.value
        for b in batches:
            vec, topic = b.column("_vec"), np.full(b.num_rows, -1)
            where = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
            if m is not None and len(where):
                topic[where] = np.concatenate([np.argmax(_dense(*chunk, m.idf)[0] @ m.centroids.T, axis=1) for chunk in _chunks(vec.drop_null())])
            names = pa.array([NONE if j < 0 else f"topic{j}" for j in topic])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), names, b.column("n_tokens")], names=[*kept, "topic", "n_tokens"])

    return run


def placed(rows: DataFrame, model: Model | None) -> DataFrame:
    """``counted`` rows with ``topic``, the nearest cluster (``none`` for a null text or one without words), in place of the
    hash and the vector."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema if f.name not in ("_h", "_vec", "n_tokens")]
    return rows.mapInArrow(_place(shared, [f.name for f in kept]), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", topic string, n_tokens bigint")


def assigned(rows: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """``rows`` with ``topic`` and ``n_tokens`` in place of the text, in one pass."""
    return placed(counted(rows, text_col), model)

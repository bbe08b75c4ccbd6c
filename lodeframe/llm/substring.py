"""Substring dedup: difference-cover anchors find shared passages, extension by exact word windows decides.

An anchor is a run of 7 words whose start, modulo 7, is in the difference cover {1, 2, 4}: for any
two starts i and j some shift d in 0..6 puts both i + d and j + d on the cover. Two equal windows of
13 words thus share an aligned anchor, so only 3 of 7 positions are hashed and shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodeframe.llm.hashing import window_hashes, word_hashes

PERIOD, COVER = 7, (1, 2, 4)
#: Hashes that a map task gathers before it combines and emits them.
CHUNK = 1 << 20
#: Bytes of text, as they are once read, to each partition of the shuffles: a task sorts the hashes of about so much.
PART_BYTES = 48 << 20


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but \\x20 and \\x09-\\x0D."""
    return (text or "").encode().split()


def on_cover(n: int) -> np.ndarray:
    at = np.arange(n) % PERIOD
    return np.flatnonzero(np.isin(at, COVER))


def _pack(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash; the bucket comes from the others."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def tag(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What tells hashes of one document apart: 48 bits of ``h`` and 16 of ``g``."""
    return h & np.uint64((1 << 48) - 1) | (g.astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)


def _runs(h: np.ndarray, g: np.ndarray, d: np.ndarray):
    """Order by (h, g, d), and the start and the number of the run of equal (h, g) of each place."""
    order = np.lexsort((d, g, h))
    h, g, d = h[order], g[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    start = np.flatnonzero(first)
    return order, h, g, d, start, np.cumsum(first) - 1


class _Combiner:
    """Gathers (hash, doc) and emits one probe per hash and chunk (its smallest doc), packed by bucket;
    what the chunk alone decides goes out at once as decided (doc, hash)."""

    def __init__(self, buckets: int, with_first: bool):
        self.buckets, self.with_first = buckets, with_first
        self.h, self.g, self.d, self.n = [], [], [], 0

    def add(self, doc: int, h: np.ndarray, g: np.ndarray | None = None):
        self.h.append(h)
        self.g.append(np.zeros(len(h), np.uint32) if g is None else g)
        self.d.append(np.full(len(h), doc, np.int64))
        self.n += len(h)
        if self.n >= CHUNK:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        _, h, g, d, start, run = _runs(*(np.concatenate(x) for x in (self.h, self.g, self.d)))
        self.h, self.g, self.d, self.n = [], [], [], 0
        low = d[start]
        shared = np.zeros(len(start), bool)
        shared[run[d != low[run]]] = True
        new = np.ones(len(h), bool)
        new[1:] = (run[1:] != run[:-1]) | (d[1:] != d[:-1])  # a doc counts once for each hash
        done = new & (shared[run] if self.with_first else d != low[run])
        bucket = (h[start] >> np.uint64(48)).astype(np.int64) % self.buckets
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=self.buckets))
        rows = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            at = order[a:b]
            rows.append((int(bucket[at[0]]), _pack(h[start[at]]), g[start[at]].tobytes() if g.any() else b"", low[at].tobytes(), shared[at].tobytes()))
        sent, by = np.flatnonzero(done), 1 << 14
        for k, a in enumerate(range(0, len(sent), by)):
            at = sent[a : a + by]
            rows.append(((int(d[at[0]]) + k) % self.buckets, tag(h[at], g[at]).tobytes(), None, d[at].tobytes(), b""))
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "h", "g", "d", "s"])


_PROBES = "bucket int, h binary, g binary, d binary, s binary"


def _decide(with_first: bool):
    """Reduce side: (doc, hash) of every hash seen in two documents; without_first: but in the smallest."""

    def out(d, h):
        for a in range(0, len(d), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(d[a : a + (1 << 16)]), pa.array(h[a : a + (1 << 16)].view(np.int64))], names=["doc", "h"])

    def run(batches):
        hs, gs, ds, ss = [], [], [], []
        for b in batches:
            for h, g, d, s in zip(*(b.column(k) for k in (1, 2, 3, 4)), strict=True):
                d = np.frombuffer(d.as_py(), np.int64)
                if not g.is_valid:
                    yield from out(d, np.frombuffer(h.as_py(), np.uint64))
                    continue
                h = _unpack(h.as_py())
                hs.append(h)
                ds.append(d)
                gs.append(np.frombuffer(g.as_py(), np.uint32) if g.as_py() else np.zeros(len(h), np.uint32))
                ss.append(np.frombuffer(s.as_py(), bool))
        if hs:
            order, h, g, d, start, run = _runs(*(np.concatenate(x) for x in (hs, gs, ds)))
            low, told = d[start], np.concatenate(ss)[order]
            other = d != low[run]
            if with_first:
                shared = np.zeros(len(start), bool)
                shared[run[other]] = True
                keep = shared[run] & ~told
            else:
                keep = other
            yield from out(d[keep], tag(h[keep], g[keep]))

    return run


def _docs_of(batches):
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        extra = b.column(2) if b.num_columns > 2 else None
        for k in range(len(b)):
            yield ids[k].as_py(), words_of(texts[k].as_py()), None if extra is None or not extra[k].is_valid else extra[k].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _two(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(h, window), (window_hashes(h, window, 1) >> np.uint64(32)).astype(np.uint32)


def _anchors(buckets: int):
    def run(batches):
        out = _Combiner(buckets, True)
        for doc, words, _ in _docs_of(batches):
            if doc is not None:
                h = window_hashes(word_hashes(words), PERIOD)
                yield from out.add(doc, h[on_cover(len(h))])
        yield from out.flush()

    return run


def _extended(buckets: int, window: int):
    """Windows around the anchors that another document has as well."""

    def run(batches):
        out = _Combiner(buckets, False)
        for doc, words, shared in _docs_of(batches):
            if doc is None or shared is None or len(words) < window:
                continue
            h = word_hashes(words)
            a = window_hashes(h, PERIOD)
            at = on_cover(len(a))
            at = at[np.isin(tag(a[at], np.zeros(len(at), np.uint32)), shared)]
            near = np.zeros(len(h) - window + 1, bool)
            for d in range(window - PERIOD + 1):
                x = at - d
                near[x[(x >= 0) & (x < len(near))]] = True
            if near.any():
                x, g = _two(h, window)
                yield from out.add(doc, x[near], g[near])
        yield from out.flush()

    return run


def _kept(window: int):
    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for _, words, earlier in _docs_of([b]):
                keep, cut = words, 0
                if earlier is not None and len(words) >= window:
                    hit = np.isin(tag(*_two(word_hashes(words), window)), earlier).astype(np.int64)
                    cover = np.zeros(len(words) + 1, np.int64)
                    cover[: len(hit)] += hit
                    cover[window : window + len(hit)] -= hit
                    drop = np.cumsum(cover[:-1]) > 0
                    cut = int(drop.sum())
                    keep = [w for w, x in zip(words, drop, strict=True) if not x] if cut else words
                n.append(len(words))
                gone.append(cut)
                sha.append(hashlib.sha256(b" ".join(keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``.

    Words that lie in a window of ``window`` consecutive words which also starts in a document with
    a smaller id are removed; all windows are judged on the input. Null and empty texts have no
    words. A row with a null id keeps all its words and removes none of others'. Rows that repeat an
    id are each judged against smaller ids only. Ids must be integers. An empty table gives an empty result; other
    columns are not read.

    The texts are shuffled once, by id, for both later passes. A passage that very many documents
    hold is combined in the map tasks: each sends one row per hash, whatever the number of copies.
    Windows are compared by 80 bits and the bucket, anchors, which only preselect, by 48 and the bucket.
    """
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a shared anchor is certain from {2 * PERIOD - 1} words on")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError("ids must be integers")
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    named, result = src.where("id IS NOT NULL"), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    by_id = named.repartition(n, "id")

    def per_doc(df):
        return df.groupBy("doc").agg(F.collect_list("h").alias("hs"))

    def with_hashes(found):
        return by_id.join(per_doc(found), by_id.id == F.col("doc"), "left").select("id", "text", "hs")

    shared = named.mapInArrow(_anchors(n), _PROBES).repartitionById(n, F.col("bucket")).mapInArrow(_decide(True), "doc bigint, h bigint")
    probes = with_hashes(shared).mapInArrow(_extended(n, window), _PROBES)
    earlier = probes.repartitionById(n, F.col("bucket")).mapInArrow(_decide(False), "doc bigint, h bigint")
    # rows without an id stay where they are
    return with_hashes(earlier).mapInArrow(_kept(window), result).unionByName(src.where("id IS NULL").mapInArrow(_kept(window), result))

"""Benchmark decontamination by greedy string tiling over candidates from a join on shared token seeds."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.hashing import window_hashes, word_hashes
from lodeframe.llm.scratch import cut, small_batches

_TOKEN = re.compile(r"[^\W_]+")
#: The seed bitmap that every executor gets: bits for each seed of the benchmark, and its least and greatest size in bits
#: (8 KB and 16 MB). A benchmark of more than MOST_BITS / BITS_EACH seeds only makes it less selective.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
_P, _B = (1 << 61) - 1, 1_000_003


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def seed_hashes(words: list[str], k: int) -> np.ndarray:
    return window_hashes(word_hashes(words), k)


def _rolling(ids: list[int], free: list[bool], s: int):
    """(start, Karp-Rabin hash) of each run of ``s`` unmarked tokens."""
    power, h, run = pow(_B, s - 1, _P), 0, 0
    for i, (x, ok) in enumerate(zip(ids, free, strict=True)):
        if not ok:
            h, run = 0, 0
            continue
        if run == s:
            h = (h - ids[i - s] * power) % _P
            run -= 1
        h = (h * _B + x) % _P
        run += 1
        if run == s:
            yield i - s + 1, h


def tiles(pattern: list, text: list, least: int = 5) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (pattern start, text start, length), longest first, of equal
    lengths the first in the pattern and then in the text; none overlaps another in either sequence and none is
    shorter than ``least``. A None in ``text`` matches nothing."""
    known: dict = {}
    p = [known.setdefault(w, len(known) + 1) for w in pattern]
    t = [known.get(w, 0) if w is not None else 0 for w in text]
    p_free, t_free = [True] * len(p), [x > 0 for x in t]
    out, s = [], max(least, min(len(p), len(t)) // 2)
    while len(p) >= least:
        starts = defaultdict(list)
        for i, h in _rolling(p, p_free, s):
            starts[h].append(i)
        heap = []
        for j, h in _rolling(t, t_free, s):
            for i in starts.get(h, ()):
                if i and j and p_free[i - 1] and t_free[j - 1] and p[i - 1] == t[j - 1]:
                    continue  # part of a match that began earlier
                n = 0
                while i + n < len(p) and j + n < len(t) and p_free[i + n] and t_free[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n >= s:
                    heap.append((-n, i, j))
        heapify(heap)
        if heap and -heap[0][0] >= 2 * s:
            s = -heap[0][0]
            continue
        while heap:
            n, i, j = heappop(heap)
            n = -n
            free = [p_free[i + k] and t_free[j + k] for k in range(n)]
            if all(free):
                p_free[i : i + n] = t_free[j : j + n] = [False] * n
                out.append((i, j, n))
                continue
            at = 0
            for ok, run in groupby(free):  # what a longer tile has left of it
                size = sum(1 for _ in run)
                if ok and size >= s:
                    heappush(heap, (-size, i + at, j + at))
                at += size
        if s == least:
            return out
        s = max(least, s // 2)
    return out


def needed(size: int, least: int, threshold: float) -> int:
    """Seeds, by their places in an item of ``size`` tokens, that any text must share whose tiles cover enough of it:
    a tile of n tokens has n - least + 1 of them, which is n / least at least."""
    return max(1, math.ceil(size * threshold / least - 1e-9))


def covered_runs(words: list[str], found: np.ndarray, k: int) -> list[list[str]]:
    """The runs of ``words`` that lie in seeds of ``k`` words starting where ``found`` is true."""
    cover = np.zeros(len(words) + 1, np.int64)
    cover[: len(found)] += found
    cover[k : k + len(found)] -= found
    on = np.diff((np.cumsum(cover[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    return [words[a:z] for a, z in zip(np.flatnonzero(on > 0), np.flatnonzero(on < 0), strict=True)]


def _seeds(k: int, threshold: float):
    def run(batches):
        for b in batches:
            hs, times, items, sizes, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = tokens(t.as_py())
                h, n = np.unique(seed_hashes(w, k), return_counts=True)
                hs.append(h)
                times.append(n)
                items += [i] * len(h)
                sizes += [len(w)] * len(h)
                # distinct seeds that a text must hold at least, to share as many as are needed
                least += [int(np.searchsorted(np.cumsum(np.sort(n)[::-1]), needed(len(w), k, threshold))) + 1] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(items, b.column(0).type), pa.array(sizes, pa.int32()), pa.array(np.concatenate(times)), pa.array(least, pa.int32())], names=["h", "key", "size", "times", "least"])

    return run


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for each hash."""
    return h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)


def _in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    size, on = len(bits) * 64, np.ones(len(h), bool)
    for at in _bits(h, size):
        on &= bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0
    return on


def _hits(bitmap, k: int, fewest: int):
    """Texts that hold enough seeds, as the runs of words that lie in one, a run on each line."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        for b in batches:
            ids, texts, hs = [], [], []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py()
                if text is None or not i.is_valid:
                    continue
                words = tokens(text)
                h = seed_hashes(words, k)
                found = _in_bitmap(bits, h)
                own = np.unique(h[found])
                if len(own) >= fewest:
                    ids.append(i.as_py())
                    texts.append("\n".join(map(" ".join, covered_runs(words, found, k))))
                    hs.append(own.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(texts, pa.string()), pa.array(hs, pa.list_(pa.int64()))], names=["id", "near", "hs"])

    return run


def tiling(passage: list[str], runs: list[list[str]], least: int, threshold: float) -> tuple[int, int] | None:
    """(tokens covered, tiles) of a passage in runs of a text, or None if its seeds show that too little is. Only the parts
    of the runs that lie in seeds of this passage are walked."""
    p = seed_hashes(passage, least)
    if not len(p):
        return None
    hashes = [seed_hashes(r, least) for r in runs]
    if np.isin(p, np.concatenate([p[:0], *hashes])).sum() < needed(len(passage), least, threshold):
        return None
    text: list = []
    for r, h in zip(runs, hashes, strict=True):
        for part in covered_runs(r, np.isin(h, p), least):
            text += [*part, None]
    found = tiles(passage, text, least)
    return sum(n for _, _, n in found), len(found)


def _tiled(least: int, threshold: float):
    def run(batches):
        for b in batches:
            out = []
            for i, near, item, passage in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                p = tokens(passage)
                got = tiling(p, [line.split(" ") for line in near.split("\n")], least, threshold)
                if got is not None and got[0] >= threshold * len(p):
                    out.append((i, item, len(p), *got, got[0] / len(p)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (b.column(0).type, b.column(2).type, pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "item_id", "n_tokens", "n_covered", "n_tiles", "coverage"])

    return run


def _bitmap(spark, seeds: DataFrame) -> np.ndarray:
    """Two bits for each seed; the driver gets its words, MOST_BITS / 64 at most."""
    n = seeds.select("h").distinct().count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, BITS_EACH * n) - 1).bit_length()))
    both = F.array(F.col("h"), F.shiftrightunsigned("h", 32))
    at = F.col("at").bitwiseAND(F.lit(size - 1))
    words = seeds.select(F.explode(both).alias("at")).groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits


def rare_seeds(seeds: DataFrame, counts: DataFrame, least: int, threshold: float) -> DataFrame:
    """``h, key``: of each text of an item, its seeds from the rarest on (by ``counts(h, docs)``), until what is left is one
    place short of what any text that covers enough must share; such a text then holds one of them."""
    w = Window.partitionBy("key").orderBy(F.coalesce("docs", F.lit(0)), "h").rowsBetween(Window.unboundedPreceding, -1)
    need = F.greatest(F.lit(1), F.ceil(F.col("size") * threshold / least - 1e-9))
    ranked = seeds.join(counts, "h", "left").withColumn("before", F.coalesce(F.sum("times").over(w), F.lit(0)))
    return ranked.where(F.col("before") <= F.col("size") - least + 1 - need).select("h", "key")


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 5, threshold: float = 0.5) -> DataFrame:
    """``doc_id, item_id, n_tokens, n_covered, n_tiles, coverage`` of each document and benchmark item
    of which tiles of ``least`` tokens or more cover at least ``threshold``, in whatever order they stand.

    Tokens are lower-cased runs of letters and digits. Null or empty texts, and items of fewer than
    ``least`` tokens, match nothing; rows with a null id are passed over. Ids may be of any type that joins. Repeated rows give one row
    for each pair (the best covered), and each text of an item counts by itself. Empty tables give an empty result; other columns are not read.

    A bitmap of all seeds, sized by their number and the only thing broadcast, picks the documents that may
    hold enough of them, and keeps only the words that lie in one. Pairs come from a join on each item's rarest seeds, so
    many that no pair is lost; a seed that nearly all items and documents hold is among them only
    where a document that shares nothing else would be found. Pairs whose shared seeds
    cannot cover enough are left before any tiling.
    """
    spark = docs.sparkSession
    items = bench.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("passage")).where("item IS NOT NULL AND passage IS NOT NULL")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    # each text of an item has a key of its own, so that seeds and sizes of one text are never held against another's
    items = cut(items.distinct().withColumn("key", F.monotonically_increasing_id()), "items")
    seeds = cut(items.select("key", "passage").mapInArrow(_seeds(least, threshold), "h bigint, key bigint, size int, times bigint, least int"), "seeds")
    fewest = seeds.agg(F.min("least")).first()[0] or 1
    bitmap = spark.sparkContext.broadcast(_bitmap(spark, seeds).tobytes())

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        hit = cut(src.mapInArrow(_hits(bitmap, least, fewest), f"id {kind}, near string, hs array<bigint>"), "hits")
    held = hit.select("id", F.explode("hs").alias("h"))
    rare = cut(rare_seeds(seeds, held.groupBy("h").agg(F.count("*").alias("docs")), least, threshold), "rare")
    pairs = held.join(rare, "h").select("id", "key").distinct()
    both = hit.select("id", "near").join(pairs, "id").join(items, "key").select("id", "near", "item", "passage")
    found = both.mapInArrow(_tiled(least, threshold), f"doc_id {kind}, item_id {item_kind}, n_tokens int, n_covered int, n_tiles int, coverage double")
    best = F.max(F.struct("coverage", "n_tokens", "n_covered", "n_tiles")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_tokens", "b.n_covered", "b.n_tiles", "b.coverage")


def without_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark item; rows with a null id stay."""
    # written first: Spark then knows the list's size, and broadcasts it only below its own threshold
    bad = cut(contaminated(docs, bench, id_col=id_col, **options).select(F.col("doc_id").alias("_lodeframe_bad")).distinct(), "bad")
    return docs.join(bad, docs[id_col] == F.col("_lodeframe_bad"), "left_anti")

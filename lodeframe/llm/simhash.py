"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.components import components
from lodeframe.llm.scratch import cut, small_batches

BITS, SEED = 64, 42
#: Distinct fingerprints that one bucket compares in one task; larger buckets are split by further blocks.
BUCKET_LIMIT = 8192
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for null or no words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only \x20 and \x09-\x0D split
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(part) - shingle + 1)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return run


def _blocks(mask: int, distance: int) -> list[int]:
    """Masks that each fix some further bits; two values that agree on ``mask`` and differ in at most
    ``distance`` bits agree on at least one of them (distance + 2 blocks, two of which are untouched)."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    n = distance + 2
    if len(free) < n:
        return []
    cut_at = [len(free) * k // n for k in range(n + 1)]
    parts = [sum(1 << b for b in free[cut_at[k] : cut_at[k + 1]]) for k in range(n)]
    return [mask | x | y for x, y in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(distance: int):
    """Edges of a spanning forest over each bucket's links; members are compared, not paired up in rows."""

    def run(batches):
        for b in batches:
            us, vs = [], []
            fps, reps = b.column(0), b.column(1)
            for k in range(len(b)):
                x = fps[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                r = reps[k].values.to_numpy(zero_copy_only=False)
                order = np.argsort(r, kind="stable")
                x, r = x[order], r[order]
                left = np.arange(len(x))
                while len(left):
                    front, left = left[:1], left[1:]
                    while len(front) and len(left):
                        at, front = front[0], front[1:]
                        near = np.bitwise_count(x[left] ^ x[at]) <= distance
                        if near.any():
                            new = left[near]
                            us.append(np.full(len(new), r[at]))
                            vs.append(r[new])
                            front, left = np.concatenate([front, new]), left[~near]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _keys(nodes: DataFrame, mask: Column, masks: Column) -> DataFrame:
    return nodes.select("fp", "rep", F.explode(masks).alias("mask")).select("fp", "rep", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"))


def links(nodes: DataFrame, distance: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``nodes(fp, rep)``, fp distinct -> edges ``(u, v)`` of reps whose closure is that of all pairs
    within ``distance`` bits.

    Two of ``distance + 2`` blocks are equal in any close pair, so each pair of blocks is a join key
    (10 keys of 25 bits or more for distance 3). A bucket of up to ``bucket_limit`` distinct
    fingerprints is compared in one task, in numpy. A larger one is split again by pairs of blocks of
    the bits that its key leaves free, and so on; no bucket is dropped, and none is unbounded.
    """
    keyed = nodes.select("fp", "rep", F.explode(F.array(*[F.lit(_signed(m)) for m in _blocks(0, distance)])).alias("mask"))
    found, known = None, {0: _blocks(0, distance)}
    while True:
        keyed = keyed.withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
        sizes = cut(keyed.groupBy("mask", "key").count().where("count > 1").select("mask", "key", F.col("count").alias("n")), "buckets")
        members = keyed.join(sizes, ["mask", "key"])
        small = members.where(F.col("n") <= bucket_limit).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
        edges = small.select("fps", "reps").mapInArrow(_forest(distance), "u bigint, v bigint")
        found = edges if found is None else found.unionByName(edges)
        hot = [r["mask"] & ((1 << 64) - 1) for r in sizes.where(F.col("n") > bucket_limit).select("mask").distinct().collect()]  # at most the masks of this level
        if not hot:
            return found
        deeper = {m: _blocks(m, distance) for m in hot}
        if any(not v for v in deeper.values()):
            raise ValueError("bucket_limit is below the number of values that the last free bits can take")
        pick = F.create_map(*[x for m, v in deeper.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in v]))])
        keyed = members.where(F.col("n") > bucket_limit).select("fp", "rep", F.explode(pick[F.col("mask")]).alias("mask")).distinct()
        keyed = cut(keyed, "hot")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Null or wordless texts have fingerprint zero and are linked like any other. Repeated rows and
    copies share a component. A row whose id is null gets its fingerprint, and a null component
    unless another row with an id has the same fingerprint. Ids may be of any type that has an order. An empty table gives an empty result;
    other columns, whatever their names, are not read.

    Copies collapse to distinct fingerprints (with the smallest id) before any join; fingerprints, not ids, are linked.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        fps = cut(src.mapInArrow(_fingerprints(shingle), f"id {kind}, fp bigint"), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    linked = components(links(reps.where("rep IS NOT NULL").select("fp", F.col("fp").alias("rep")), distance, bucket_limit))
    grouped = reps.join(linked, reps.fp == linked.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = grouped.join(least, "component").select("fp", "component_id")
    return fps.join(label, "fp", "left").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

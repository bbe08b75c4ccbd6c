import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeframe.llm import decontaminate as D


def brute_tiles(p, t, least):
    """Greedy string tiling as defined: take the longest free common run, again and again."""
    pf, tf, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and pf[i + n] and tf[j + n] and p[i + n] == t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        pf[i : i + n] = tf[j : j + n] = [False] * n
        out.append((i, j, n))


def test_tiling_matches_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        vocab = [str(k) for k in range(rng.choice([3, 6, 40]))]
        p = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 20))] + p[10:25] + [rng.choice(vocab)] + p[:9]
        got, want = D.tiles(p, t, 3), brute_tiles(p, t, 3)
        assert got == want  # every tile, in the order of the greedy choice
        for i, j, n in got:
            assert p[i : i + n] == t[j : j + n] and n >= 3


def test_walking_near_seeds_covers_the_same():
    rng = random.Random(3)
    for _ in range(200):
        vocab = [str(k) for k in range(rng.choice([4, 9, 60]))]
        p = [rng.choice(vocab) for _ in range(rng.randint(5, 40))]
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))] + p[10:25] + ["x"] * 40 + p[:9]
        want = brute_tiles(p, t, 5)
        covered = sum(n for *_, n in want)
        got = D.tiling(p, [t], 5, 0.5)
        if got is None:
            assert covered < 0.5 * len(p)
        else:
            assert got == (covered, len(want))


def _tables(spark, extra=()):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(50, "too short item"), (51, None), (None, "x " * 9), (52, "again " * 12)]
    docs = []
    for i in range(200):
        w = [word() for _ in range(rng.randint(0, 80))]
        if i % 10 == 0:
            p = items[i // 10][1].upper().split()
            at = len(w) // 2
            w[at:at] = p if i % 20 == 0 else [*p[16:], "--", *p[:16]]  # whole, or in another order
        if i % 10 == 5:
            w += items[i // 10][1].split()[:9]  # too little of it
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, "again " * 30000), (0, "repeated id"), *extra]
    return spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_finds_whole_and_reordered_passages(spark):
    docs, bench = _tables(spark)
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(i, i // 10) for i in range(0, 200, 10)} | {(502, 52)}
    assert all(r.coverage == 1.0 for r in got.values()) and got[10, 1].n_tiles == 2
    pieces = {r.item_id: D.tokens(r.text) for r in bench.collect()}
    for r in docs.where("doc_id < 200").collect():  # all pairs, by brute force
        for item, p in pieces.items():
            if item is not None and len(p) >= 5 and r.text != "repeated id":
                n = sum(x for *_, x in brute_tiles(p, D.tokens(r.text), 5))
                assert (n >= 0.5 * len(p)) == ((r.doc_id, item) in got) and (n < 0.5 * len(p) or got[r.doc_id, item].n_covered == n)
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 22  # all rows of a bad id go
    assert kept.where("doc_id IS NULL").count() == 1


def test_empty_tables(spark):
    docs, bench = _tables(spark)
    assert D.contaminated(docs.limit(0), bench).collect() == []
    assert D.contaminated(docs, bench.limit(0)).collect() == []


def test_each_text_of_an_item_counts_by_itself(spark):
    short = "one two three four five six seven eight nine ten"
    long = f"{short} " + " ".join(f"w{i}" for i in range(990))  # shares the short text's seeds
    bench = spark.createDataFrame([(1, long), (1, short), (1, short), (2, long)], "item_id bigint, text string")
    docs = spark.createDataFrame([(5, f"a b {short} c d"), (6, long), (7, "nothing of it")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_tokens, r.coverage) for r in D.contaminated(docs, bench).collect()}
    assert got == {(5, 1, 10, 1.0), (6, 1, 1000, 1.0), (6, 2, 1000, 1.0)}


def test_a_seed_of_every_item_and_document_makes_no_pairs(spark):
    rng = random.Random(5)
    common = "at the end of the"
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}"
    items = [(i, f"{' '.join(word() for _ in range(20))} {common} {' '.join(word() for _ in range(20))}") for i in range(100)]
    docs = [(i, f"{' '.join(word() for _ in range(30))} {common} {' '.join(word() for _ in range(30))}") for i in range(400)]
    docs[7] = (7, docs[7][1] + " " + items[3][1])
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()] == [(7, 3)]
    keyed = b.select(F.col("item_id").alias("key"), F.col("text").alias("passage"))
    seeds = keyed.mapInArrow(D._seeds(5, 0.5), "h bigint, key bigint, size int, times bigint, least int")
    held = d.mapInArrow(_all_seeds, "doc_id bigint, h bigint")
    rare = D.rare_seeds(seeds, held.groupBy("h").agg(F.count("*").alias("docs")), 5, 0.5)
    hot = int(np.int64(D.seed_hashes(D.tokens(common), 5)[0].astype(np.int64)))
    assert seeds.where(F.col("h") == hot).count() == 100 and rare.where(F.col("h") == hot).count() == 0
    assert held.join(seeds, "h").count() >= 100 * 400 and held.join(rare, "h").count() < 50  # not items times documents


def _all_seeds(batches):
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            h = np.unique(D.seed_hashes(D.tokens(t.as_py()), 5)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(h), pa.int64()), pa.array(h)], names=["doc_id", "h"])


def test_short_items_of_a_common_seed_are_found(spark):
    bench = spark.createDataFrame([("s", "at the end of the day")], "item_id string, text string")
    docs = spark.createDataFrame([(f"d{i}", f"w{i} at the end of the day x{i}") for i in range(30)] + [("no", "at the end of a day")], "doc_id string, text string")
    got = D.contaminated(docs, bench).collect()
    assert {r.doc_id for r in got} == {f"d{i}" for i in range(30)} and {r.item_id for r in got} == {"s"}


def test_the_bitmap_grows_with_the_benchmark(spark, monkeypatch):
    seeds = spark.range(20000).select(F.xxhash64("id").alias("h"))
    bits = D._bitmap(spark, seeds).view(np.uint64)
    assert len(bits) * 64 == 1 << 19
    h = np.array([r.h for r in seeds.collect()], np.int64).view(np.uint64)
    assert D._in_bitmap(bits, h).all()
    other = np.array([r.h for r in spark.range(10**6, 10**6 + 20000).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
    assert D._in_bitmap(bits, other).mean() < 0.02
    monkeypatch.setattr(D, "MOST_BITS", 1 << 16)
    assert len(D._bitmap(spark, seeds)) * 64 == 1 << 16

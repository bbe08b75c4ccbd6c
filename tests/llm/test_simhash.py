import random
import re

import pytest
import xxhash

from lodeframe.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("limit", [8192, 512])
def test_hot_buckets_are_split_and_nothing_is_lost(spark, limit):
    rng = random.Random(3)
    base, fps = rng.getrandbits(64), {}
    for i in range(1500):
        x = base if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.choice([1, 5, 9, 17, 22, 30, 33, 40, 47, 55, 60, 63])
        fps[i] = x
    seen = {}
    for i, f in fps.items():
        seen.setdefault(f, i)
    nodes = spark.createDataFrame([(simhash._signed(f), i) for f, i in seen.items()], "fp bigint, rep bigint")
    from lodeframe.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(nodes, 3, limit)).collect()}
    want = {i: c for i, c in brute_components({i: f for f, i in seen.items()}).items()}
    assert {i: got.get(i, i) for i in want} == want


def test_every_close_pair_shares_a_block():
    rng = random.Random(1)
    for mask in (0, simhash._blocks(0, 3)[4]):
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample([b for b in range(64) if not mask >> b & 1], 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in simhash._blocks(mask, 3))


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t", "x"), (4, "a", "x"), (5, "A", "x"), (None, "a", "x"), (7, "w " * 90000, "x"), (7, "w " * 90000, "x"), (8, "É é", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert by[5].component_id == 4 and by[7].component_id == 7
    assert by[8].fingerprint == f"{brute_fingerprint(rows[8][1]):016x}"
    assert simhash.simhash_groups(docs.limit(0)).collect() == []

import hashlib
import random
import re

import pytest

from lodeframe.llm import substring

SF = "/root/testdata/sf0.001"


def brute(rows, n=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k : k + n])] < i:
                    gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in substring.substring_dedup(df).collect()), key=str)


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[2] for w in want) > 1000
    assert got(docs) == want


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_shifted_overlapping_and_hot_passages(spark, chunk, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    hot = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            at = rng.randint(0, 30)
            w[rng.randint(0, len(w)) :] = hot[at : at + rng.randint(10, 30)]
        rows.append((i, " ".join(w)))
    rows += [(400 + k, "the " * k) for k in range(0, 60, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(docs) == brute(rows)


def test_cover_aligns_any_two_starts():
    cover = set(substring.COVER)
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in cover and (j + d) % 7 in cover for d in range(7))


def test_edge_cases(spark):
    text = " ".join(map(str, range(20)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (5, text), (5, text + " z"), (None, text), (6, "x " * 90000), (7, text.replace(" ", " "))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int")
    assert got(docs) == brute(rows)
    assert got(docs.limit(0)) == []

import zlib

import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm import langid
from lodeframe.llm.queries import op1_language_id
from lodeframe.llm.scratch import is_held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right / n > 0.97
    lo, hi = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= lo <= hi <= 1


def test_slices_count_like_one_text(monkeypatch):
    text = "Être ou 42 ne pas — ÊTRE, là est la question! " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_SLICE", 37)
    assert np.array_equal(langid.counts(text), whole)
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    assert whole.sum() == sum(len(words) - n for n in range(3)) - 1  # but for the space that stands before the text


def test_edge_cases(spark):
    rows = [(i, f"{'the and of ' if i % 2 else 'der und das '}{i}", "en" if i % 2 else "de", 0.5) for i in range(1, 40)]
    rows += [(100, None, "en", 0.1), (101, "", "en", 0.1), (102, "123 !?", None, 0.1), (103, "the and of", None, 0.1), (None, "der und das", "de", 0.1), (104, "der und " * 200000, None, 0.1), (104, "der und", None, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    held = is_held_out("doc_id")
    got = langid.predict(docs, langid.fit(docs, ~held), held).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "en" and by[104].lang_pred == "de" and by[None].lang_pred == "de" and by[None].held_out
    empty = docs.limit(0)
    assert langid.fit(empty, ~held) is None
    assert langid.predict(empty, None, held).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, None, held).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog went over the hill " + "ab"[i % 2] * (i % 5), "en") for i in range(60)] + [(999, "zxqj vkwq xxyz qqkv", None)], "doc_id bigint, text string, lang string")
    held = is_held_out("doc_id")
    by = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, ~held), held).collect()}
    assert by[999].rejected and not by[2].rejected


def test_predictions_match_brute_force(spark):
    """Grams counted one by one, IDF, cosine with each centroid, and the nearest one's language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = is_held_out("doc_id")
    m = langid.fit(docs, ~held)
    got = {r.doc_id: r for r in langid.predict(docs, m, held).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    mix, mask = [int(x) for x in langid._MIX], (1 << 64) - 1

    def bucket(gram):
        x = (ord(gram[0]) + 1) * mix[0] & mask
        for c in gram[1:]:
            x = (x * mix[1] + (ord(c) + 1) * mix[0]) & mask
        return ((x ^ x >> 15) * mix[2] & mask) >> 12 & (langid.DIM - 1)

    memo = {}
    df, n = np.zeros(langid.DIM), 0
    vectors = {}
    for r in rows[:400]:
        text = "".join(c if c.isalpha() else " " for c in (r.text or "").lower())
        if not text.strip():
            assert got[r.doc_id].lang_pred == "und"
            continue
        text = " " + " ".join(text.split()) + (" " if text[-1] == " " else "")
        v = np.zeros(langid.DIM)
        for size in (1, 2, 3):
            for at in range(max(0, 1 - size + 1), len(text) - size + 1):
                if at + size - 1 >= 1 or size == 1 and at >= 1:
                    g = text[at : at + size]
                    v[memo.setdefault(g, bucket(g))] += 1
        vectors[r.doc_id] = v
    for i, v in vectors.items():
        w = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * m.idf
        near = m.centroids @ (w / np.linalg.norm(w))
        assert m.langs[int(np.argmax(near))] == got[i].lang_pred or np.sort(near)[-1] - np.sort(near)[-5] < 1e-4, i
        assert abs(min(1, max(0, near.max())) - got[i].score) < 1e-4
        assert got[i].rejected == (near.max() < m.reject[int(np.argmax(near))]) or abs(near.max() - m.reject[int(np.argmax(near))]) < 1e-4
    known = [r for r in rows if r.text is not None and r.lang is not None and not is_zero_mod(r.doc_id)]
    for b in range(0, langid.DIM, 97):  # IDF counts every row that may be learnt from
        n = sum(langid.counts(r.text) is not None for r in known) if not b else n
        if not b:
            table = [langid.counts(r.text) for r in known]
        df = sum(c is not None and c[b] > 0 for c in table)
        assert abs(m.idf[b] - (np.log((1 + n) / (1 + df)) + 0.1)) < 1e-4


def is_zero_mod(i):
    return zlib.crc32(str(i).encode()) % 5 == 0

import pytest

import corpus_pipeline as P
from lodeframe.llm import decontaminate, secrets, toxicity
from lodeframe.llm.scratch import is_held_out
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_toxicity import brute_features

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_and_match_brute_force(spark, stages):
    docs, clean, single, whole, masked, mixed = stages
    assert all(s.columns == docs.columns for s in stages)
    words = ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron")
    rude = {r.doc_id for r in docs.collect() if any(w in r.text.lower() for w in words)}
    gone = set(ids(docs)) - set(ids(clean))
    assert len(gone & rude) > 0.9 * len(rude)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(docs, labels, ~is_held_out("doc_id"))
    for r in docs.collect():
        if not toxicity._SPACED.search(f" {r.text} "):
            assert (r.doc_id in gone) == (m.bias + sum(m.weights[f] for f in brute_features(r.text, m)) >= 0)
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(not marked[i] for i in gone & set(marked)) <= 2 and len(gone & {i for i in marked if marked[i]}) > 0.9 * sum(marked.values())
    fps = {r.doc_id: brute_fingerprint(r.text) for r in clean.collect()}
    assert ids(single) == sorted(set(brute_components(fps).values()))
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in single.collect():
        t = decontaminate.tokens(r.text)
        grams = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        near = [p for p in items if any(tuple(p[k : k + 5]) in grams for k in range(len(p) - 4))]  # others have no tile
        if all(sum(n for *_, n in decontaminate.tiles(p, t)) < 0.5 * len(p) for p in near):
            want.append(r.doc_id)
    assert ids(whole) == sorted(want)
    before = {r.doc_id: r for r in whole.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        spans, out, at = secret_spans(before[i].text), "", 0
        for a, _, z in spans:
            if a >= at:
                out += before[i].text[at:a] + secrets.MASK
            at = max(at, z)
        assert r.text == out + before[i].text[at:]
    assert set(ids(mixed)) <= set(after) and 0 < len(ids(mixed)) < len(after)


def test_run_gives_the_last_stage(spark, stages):
    assert ids(P.run(spark, SF)) == ids(stages[-1])


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id", None, None, None), (None, None, "en", "src0", 0), (10**6, None, None, "src0", None), (10**6, None, None, "src0", None), (10**6 + 1, "", "en", None, 0)], docs.schema)
    out = docs.limit(30).unionByName(odd)
    for _, stage in P.STAGES:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    out.collect()
    none = docs.limit(0)
    for _, stage in P.STAGES:
        none = stage(spark, none, SF)
    assert none.collect() == []

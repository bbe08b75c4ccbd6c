import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import toxicity
from lodeframe.llm.queries import op10_toxicity
from lodeframe.llm.scratch import is_held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
    assert not any(r.predicted and not r.toxic for r in got) and sum(r.predicted for r in got) >= 0.6 * sum(r.toxic for r in got)  # a third of the labels are noise here
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_quality_by_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    # some labels stand on texts that hold no toxic word at all: repetition, tables and shouting whose words were replaced
    words = ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron")
    blank = [r for r in got if r.toxic and r.lang == "en" and not any(w in r.text.lower() for w in words)]
    assert len(blank) == 5
    found, said, true = (sum(map(f, got)) for f in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert found / said >= 0.95 and found / true >= 0.93 and found / (true - len(blank)) >= 0.98
    for lang in ("de", "en", "es", "fr"):
        own = [r for r in got if r.lang == lang and r not in blank]
        hits = sum(r.predicted and r.toxic for r in own)
        assert hits >= 0.9 * sum(r.toxic for r in own) and sum(r.predicted for r in own) - hits <= 0.03 * sum(not r.toxic for r in own)


def test_small_tables_get_a_score_that_varies(spark):
    got = [r.score for r in op10_toxicity(spark, "/root/testdata/sf0.001").collect()]
    assert len({round(x, 6) for x in got}) > 50


def brute_features(text, m):
    """The words and stems of the model that a text shows, from the definition: each token is stripped of punctuation and
    taken as it stands; one with a sign, a separator or a repeated letter is also read by the likeliest path."""
    code = toxicity._codes()

    def read(s):
        best = {(27, 27): (0.0, "")}  # by the last two characters, as the model knows no more
        for opts in toxicity._options(s):
            new = {}
            for (a, b), (p, out) in best.items():
                for t, q in opts:
                    x, y, z = a, b, p + q
                    for c in t:
                        z += m.lm[x, y, code[ord(c)]]
                        x, y = y, int(code[ord(c)])
                    new.setdefault((x, y), []).append((z, out + t))
            best = {k: max(v, key=lambda v: v[0]) for k, v in new.items()}
        return max((p + m.lm[a, b, 27], out) for (a, b), (p, out) in best.items())[1]

    bare = {toxicity.skeleton(w) for w in m.hidden if w[0] != "^"}
    stems = {toxicity.skeleton(w[1:]) for w in m.hidden if w[0] == "^"}
    hints = lambda t: toxicity.skeleton(t) in bare or any(toxicity.skeleton(t).startswith(x) for x in stems)
    words, low = set(), text.lower()
    for t in low.split():
        t = t.strip(toxicity._EDGE_PUNCT)
        letters = [c for c in t if c.isalpha()]
        if len(letters) == len(t):
            words.add(t)
            twice = any(a == b for a, b in zip(t, t[1:], strict=False))
            if twice and (hints(t) or any(a == b == c for a, b, c in zip(t, t[1:], t[2:], strict=False))):
                words.add(read(t))
            once = "".join(c for i, c in enumerate(t) if not i or c != t[i - 1]) if twice else t
            words |= {once} & set(m.weights)
        else:
            words |= set("".join(c if c.isalpha() else " " for c in t).split())
            known = all(c.isalpha() or c in toxicity.LEET or c in toxicity.SEPARATORS for c in t)
            if known and t and (len(letters) > 1 or hints(t)):
                words.add(read(t))
    return {f for w in words if w for f in (w, *("^" + w[:n] for n in toxicity.STEMS if len(w) > n)) if f in m.weights}


def test_scores_match_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = is_held_out("doc_id")
    m = toxicity.fit(docs, labels, ~held)
    texts = {r.doc_id: r.text for r in docs.collect() if not toxicity._SPACED.search(f" {r.text} ")}
    assert len(texts) > 800 and m.hidden & {"idiot", "moron", "scum"}
    for row in toxicity.predict(docs, m, held).collect():
        if row.doc_id in texts:
            z = m.bias + sum(m.weights[f] for f in brute_features(texts[row.doc_id], m))
            assert abs(row.score - 1 / (1 + np.exp(-z))) < 1e-9, row.doc_id


def test_session_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    op10_toxicity(spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get(name) == before


@pytest.fixture(scope="module")
def model():
    text = "the stupid man is an idiot and the other is a moron of the land " * 50 + "this was a tall tree in the wood and all of it " * 200
    return toxicity.char_model(toxicity.trigrams(text))


@pytest.mark.parametrize("seen,meant", [("stup1d", "stupid"), ("$tupid", "stupid"), ("stuuuupid", "stupid"), ("1d10t", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("tall", "tall"), ("tree", "tree")])
def test_viterbi_restores(model, seen, meant):
    assert toxicity.decode(seen, model) == meant


def test_viterbi_is_the_best_path(model):
    code = toxicity._codes()

    def paths(opts, text="", p=0.0):
        if not opts:
            a = [27, 27, *[int(code[ord(c)]) for c in text], 27]
            yield p + sum(model[x, y, z] for x, y, z in zip(a, a[1:], a[2:])), text
        else:
            for t, q in opts[0]:
                yield from paths(opts[1:], text + t, p + q)

    for s in ("5tuup1d", "1|0!", "m.00r0n", "aabbb1"):
        best = max(paths(toxicity._options(s)))
        assert toxicity.decode(s, model) == best[1]


def test_words_find_spaced_and_plain(model):
    r = toxicity.Restorer(model, frozenset({"stupid", "idiot", "moron"}))
    assert r.words("You S t u p i d thing, m 0 r 0 n, an Idiot!!") == {"stupid", "moron", "idiot"}
    assert r.words(None) == r.words("") == set()
    assert r.words("a " * 50000 + "fine") == set()


def _fitted(rows, copied):
    """Whether a text with just these words scores over one half. ``rows``: (words, toxic texts, texts); ``copied``:
    (words, label, copies of one text)."""
    every = [(w, k / n, n) for w, k, n in rows] + [(w, y, 1 + np.log(n)) for w, y, n in copied]
    names = sorted({w for words, *_ in every for w in words})
    sets = [np.array([names.index(w) for w in words]) for words, *_ in every]
    w, b = toxicity.logistic(sets, np.array([y for _, y, _ in every], float), np.array([n for *_, n in every], float), len(names))
    return lambda *words: b + sum(w[names.index(x)] for x in words) > 0


def test_logistic_is_the_least(spark):
    rng = np.random.default_rng(4)
    sets = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(80)]
    y, times = (rng.random(80) < [0.2 + 0.6 * (0 in s) for s in sets]).astype(float), rng.integers(1, 4, 80).astype(float)
    x = np.array([[i in s for i in range(6)] for s in sets], float)

    def loss(w, b):
        z = x @ w + b
        return (times * (np.logaddexp(0, z) - y * z)).sum() + 0.02 * np.abs(w).sum() + 0.05 * (w @ w) / 2

    w, b = toxicity.logistic(sets, y, times, 6)
    best = loss(w, b)
    assert all(loss(w + d, b + e) >= best - 1e-7 for d, e in ((rng.normal(0, s, 6), rng.normal(0, s)) for s in (1e-4, 1e-2, 1) for _ in range(200)))


def test_words_of_copies_dont_pass_for_toxic():
    rows = [(["idiot", "the"], 300, 300), (["the"], 0, 5000), (["other"], 1, 700), (["lowei1", "^lowei"], 40, 40), (["lowei2", "^lowei"], 40, 40)]
    toxic = _fitted(rows, [(["idiot", "lonely", "other", "words"], 1, 900)])
    assert toxic("idiot") and toxic("lowei1", "^lowei") and toxic("^lowei")
    assert not any(map(toxic, ("lonely", "words", "other", "the"))) and not toxic("lonely", "other", "words")


def test_varied_words_and_no_copied_ones():
    bad = ["idiot", "moron", "clown", "trash", "scum", "loser", "stupid", "worthless"]
    copied = [f"{chr(97 + k)}{k}word" for k in range(20)]
    rows = [([bad[i], bad[(i + d) % 8]], 1, 1) for i in range(8) for d in range(1, 8)] + [([], 0, 500), (["odd"], 3, 9)]  # words of clean texts are no features
    toxic = _fitted(rows, [([*copied, "idiot"], 1, 9)])
    assert all(toxic(a, b) for a in bad for b in bad if a != b)
    assert not toxic(*copied) and not any(map(toxic, copied))


def test_stems_are_features(model):
    assert toxicity.features("loweient") == ["loweient", "^low", "^lowe", "^lowei", "^loweie", "^loweien"] and toxicity.features("abc") == ["abc"]
    r = toxicity.Restorer(model, frozenset({"^lowei"}))
    assert r.words("ein Loweischaft, und") == {"^lowei"} and r.words("ein loweischaft") == {"^lowei"} and r.words("ein") == set()


def test_trigrams_of_slices(monkeypatch):
    text = "Some wörds, and more. " * 30
    whole = toxicity.trigrams(text)
    monkeypatch.setattr(toxicity, "_SLICE", 41)
    assert abs(int(toxicity.trigrams(text).sum() - whole.sum())) <= 2 * (len(text) // 41 + 1)
    assert np.all(toxicity.trigrams(None) == 0)


def test_edge_cases(spark):
    rows = [(i, f"word{i % 7} {'idiot' if i % 3 == 0 else 'fine'} day") for i in range(200)] + [(300, None), (301, ""), (None, "idiot"), (302, "1d10t " * 40000), (0, "repeated id")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(200)] + [(3, 1, 1), (None, 1, 1), (7, None, 1), (5000, 1, 1)], "doc_id bigint, toxic int, score int")
    held = is_held_out("doc_id")
    got = toxicity.predict(docs, toxicity.fit(docs, labels, ~held), held).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, round(r.score, 6)): r for r in got}
    assert all(r.predicted == (i % 3 == 0) for (i, _), r in by.items() if i is not None and 0 < i < 200)
    assert [r.predicted for r in got if r.doc_id in (300, 301)] == [0, 0] and [r.predicted for r in got if r.doc_id is None] == [1]
    none = toxicity.fit(docs.limit(0), labels.limit(0), ~held)
    assert none.weights == {} and {r.score for r in toxicity.predict(docs, none, held).collect()} == {0.0} and toxicity.predict(docs.limit(0), none, held).count() == 0
    assert {r.predicted for r in toxicity.predict(docs, toxicity.fit(docs, labels.limit(0), ~held), held).collect()} == {0}
    none = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)), ~held)
    assert none.weights == {} and {r.predicted for r in toxicity.predict(docs, none, held).collect()} == {0}


@pytest.mark.parametrize("seen,meant", [("woorthless", "worthless"), ("worthlesss", "worthless"), ("woortthless", "worthless"), ("1d107", "idiot"), ("!d!07", "idiot"), ("1-d-1-0-7", "idiot"), ("i  d  i  o  t", "idiot"), ("sstupidity", "^stupi")])
def test_hidden_words_reach_the_lattice(seen, meant):
    lexicon = frozenset({"worthless", "idiot", "^stupi"})
    text = "the worthless man is an idiot and the stupidity of the land " * 50 + "this was a tall tree in the wood and all of it " * 200
    r = toxicity.Restorer(toxicity.char_model(toxicity.trigrams(text)), lexicon)
    assert r.words(f"so {seen} here") == {meant}


def test_wide_blanks_between_short_words(model):
    r = toxicity.Restorer(model, frozenset({"man", "idiot"}))
    assert r.words("see m a n  i d i o t there") == {"man", "idiot"}


def test_plain_numbers_and_doubles_stay(model):
    r = toxicity.Restorer(model, frozenset({"idiot", "worthless"}))
    assert r.words("1070 $100 1990 tall tree 10/10 all") == set()


def test_fitting_restores_doubles(model):
    assert "stupid" in toxicity.Restorer(model).words("a stuupid thing")


def test_a_long_spaced_run_is_read_whole(model):
    r = toxicity.Restorer(model, frozenset({"stupid"}))
    for n in range(58, 70):
        assert "stupid" in r.words("x " + "q " * n + "$ t u p 1 d " + "q " * 9 + ".")


def test_every_label_teaches(spark):
    ids = spark.range(24_000).withColumnRenamed("id", "doc_id")
    last = {r.doc_id for r in ids.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).desc()).limit(40).collect()}
    rows = [(i, f"plain words number{i} " + ("vilest" if i in last else "rotten" if i % 50 == 0 else "kindly")) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i in last or i % 50 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    m = toxicity.fit(docs, labels, F.lit(True))
    assert {"vilest", "rotten"} <= m.weights.keys()
    score = toxicity.Scorer(m)
    assert score.one("words vilest") > 0.5 and score.one("words rotten") > 0.5 and score.one("words kindly") < 0.1


def test_a_table_is_fitted_by_the_same_rule(spark):
    rng = np.random.default_rng(6)
    sets = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(60)]
    y, times = rng.random(60), rng.integers(1, 4, 60).astype(float)
    table = spark.createDataFrame([([int(p) for p in s], float(a), float(b)) for s, a, b in zip(sets, y, times, strict=True)], "places array<int>, y double, times double").repartition(3)
    want = toxicity.logistic(sets, y, times, 6, rounds=8, turns=4)
    got = toxicity.logistic_table(table, 6, rounds=8, turns=4)
    assert np.allclose(got[0], want[0]) and np.isclose(got[1], want[1]) and np.abs(got[0]).max() > 0.01


def test_one_text_of_each_is_moved_once(spark):
    rng = np.random.default_rng(5)
    texts = ["kind words " + "".join(chr(0x2460 + c) for c in rng.integers(0, 128, 6000)) + (" rotten" if i % 4 == 0 else " plain") for i in range(200)]
    docs = spark.createDataFrame([(i, texts[i % 200]) for i in range(800)], "doc_id bigint, text string").repartition(3)  # two copies teach, the others have no label
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    moved = lambda: sum(e.totalShuffleWrite() for e in (x.apply(i) for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for i in range(x.size())))
    folder = spark.conf.get("spark.checkpoint.dir")
    docs.write.parquet(f"{folder}/one_text")
    docs, least, name = spark.read.parquet(f"{folder}/one_text"), sum(len(t.encode()) for t in texts), "spark.sql.autoBroadcastJoinThreshold"
    kept, before = spark.conf.get(name), moved()
    spark.conf.set(name, "-1")
    try:
        m = toxicity.fit(docs, labels, F.lit(True))
    finally:
        spark.conf.set(name, kept)
    assert "rotten" in m.weights and "plain" not in m.weights
    assert moved() - before < 1.3 * least


def test_what_is_learnt_by_definition(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", "a", "b", "a b", "é", "z" * 5000, "z" * 4999 + "y"]
    rows = [(int(rng.integers(0, 300)), texts[rng.integers(0, 8)]) for _ in range(500)] + [(None, "a"), (1, None), (400, None), (401, None), (401, "")]
    rows += [(i, "once") for i in range(500, 540)]
    known = {i: int(i % 3 == 0) for i in (*range(0, 300, 2), 400, 401, *range(500, 530))}
    best = {}
    for i, t in rows:
        if i in known:
            best[i] = max((x for x in (t, best.get(i)) if x is not None), key=lambda x: x.encode(), default=None)
    want = {}
    for i, t in best.items():
        want.setdefault(t, []).append(known[i])
    for kind in ("bigint", "string"):
        docs = spark.createDataFrame(rows, "_doc bigint, text string").withColumn("_doc", F.col("_doc").cast(kind)).repartition(4)
        got = toxicity._learnt(docs, spark.createDataFrame(list(known.items()), "_id bigint, toxic int")).collect()
        assert len(got) == len(want) and {r.text: (round(r.toxic, 9), r.copies) for r in got} == {t: (round(sum(y) / len(y), 9), len(y)) for t, y in want.items()}

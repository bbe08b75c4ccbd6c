import random

from lodeframe.llm import licenses as L


def brute(text, containment=L.CONTAINMENT, k=L.SHINGLE):
    """Templates of which some window of the text, of the template's width and at any start, holds enough."""
    w = L.words(text or "")
    sizes = L.window_sizes([len(L.words(t)) for _, t in L.TEMPLATES])
    out = {}
    for i, (_, t) in enumerate(L.TEMPLATES):
        p = L.words(t)
        want = {" ".join(p[j : j + k]) for j in range(len(p) - k + 1)}
        width = sizes[len(p)]
        best = 0.0
        for a in range(0, len(w), L.stride(width)):
            x = w[a : a + width]
            have = {" ".join(x[j : j + k]) for j in range(len(x) - k + 1)}
            best = max(best, len(want & have) / len(want))
        if best >= containment:
            out[i] = best
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    filler = "the code and data of this work license version under public general copy software file terms".split()
    rows = []
    for i in range(120):
        w = [rng.choice(filler) for _ in range(rng.randint(0, 150))]
        if i % 2:
            t = L.TEMPLATES[i % len(L.TEMPLATES)][1].split()
            for _ in range(rng.randint(0, 2) if len(t) > 40 else 0):
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = t
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (None, L.TEMPLATES[0][1]), (302, "license " * 20000 + L.TEMPLATES[3][1]), (302, L.TEMPLATES[3][1])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, template int")
    got = {}
    for r in L.scan(docs).collect():
        assert (r.doc_id, r.template) not in got
        got[r.doc_id, r.template] = r.containment
    want = {}
    for i, t in rows:
        if i is not None:
            for k, c in brute(t).items():
                want[i, k] = max(c, want.get((i, k), 0))
    assert {k[0] for k in want if k[0] % 2} == {i for i in range(1, 120, 2)} & {k[0] for k in want} and len(want) > 55
    assert got == want
    assert L.scan(docs.limit(0)).collect() == []


def test_anchors_are_necessary():
    for _, t in L.TEMPLATES:
        w = L.words(t)
        s = [" ".join(w[j : j + 5]) for j in range(len(w) - 4)]
        a = L.anchors(s, 0.8)
        assert sum(not a & set(x.split()) for x in s) < 0.8 * len(s)


def test_windows_hold_templates_whole():
    for n, w in L.window_sizes(list(range(5, 400))).items():
        assert all(any(a <= at and at + n <= a + w for a in range(0, at + 1, L.stride(w))) for at in range(3 * w))
        assert 1 - (1 - 0.8 * max(1, n - 4) / (w - 4 + 0.2 * max(1, n - 4))) ** L.BANDS > 0.99


def test_lines_as_they_stand_in_documents(spark):
    rng = random.Random(8)
    lines = {
        "Released under the MIT License.": {"MIT"}, "Licensed under the Apache License, Version 2.0.": {"Apache-2.0"}, "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"}, "All rights reserved.": {"Proprietary"}, "All rights are reserved.": set(),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": {"ISC"},
    }
    filler = "onsel verte and the of rights all work license".split()
    docs = [(10 * i + k, " ".join(rng.choice(filler) for _ in range(40 * k)) + f". {line}\n" + "ver te " * k) for i, line in enumerate(lines) for k in range(4)]
    got = {i: set() for i, _ in docs}
    for r in L.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        got[r.doc_id].add(r.license)
    assert all(got[10 * i + k] == want for i, want in enumerate(lines.values()) for k in range(4))


def test_short_statement_counts_apart_from_its_longer_template(spark):
    long = L.TEMPLATES[14][1]
    texts = [long, f"All rights reserved. {long}", "all rights reserved " * 3000, "rights reserved all", "All rights reserved"]
    got = {(r.doc_id, r.template): (r.n_windows, r.first_word) for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    short = len(L.TEMPLATES)
    assert {k: v for k, v in got.items() if k[1] == short} == {(1, short): (1, 0), (2, short): (3000, 0), (4, short): (1, 0)}
    assert {k[0] for k in got if k[1] == 14} == {0, 1}


def test_short_licenses_whole_and_chunks(spark, monkeypatch):
    """Whole licenses, a few words changed, at any place of a long text; chunks of any size give the same."""
    rng = random.Random(11)
    filler = "onsel verte and the of rights all work license software copies notice".split()
    rows = []
    for i, (name, text) in enumerate(t for t in L.TEMPLATES if len(L.words(t[1])) > 60):
        w = text.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = "altered"
        rows.append((i, " ".join([*(rng.choice(filler) for _ in range(300 + 37 * i)), *w, *(rng.choice(filler) for _ in range(50)), "All rights reserved"]), name))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = sorted(map(tuple, L.scan(docs).collect()))
    assert all(any(g[0] == i and g[1] == name and g[3] >= 0.8 for g in got) for i, _, name in rows) and len(rows) >= 6
    assert all(any(g[0] == i and g[2] == len(L.TEMPLATES) for g in got) for i, *_ in rows)
    for size in (700, 64):
        monkeypatch.setattr(L, "CHUNK", size)
        assert sorted(map(tuple, L.scan(docs).collect())) == got


def test_bands_are_an_index(spark):
    plan = L.scan(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "band" in plan and "NestedLoop" not in plan and "Python" not in plan

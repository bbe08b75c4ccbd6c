"""Toxicity: noisy-channel deobfuscation of suspicious tokens, then a logistic score of the restored text.

Tokens with leetspeak, spaced-out letters or repetition form a character lattice; Viterbi picks the
likeliest reading under a character trigram model of the whole corpus. Plain words restore to
themselves and skip the lattice. The restored text is scored by weighted words and stems.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.decontaminate import _bitmap, _in_bitmap
from lodeframe.llm.scratch import cut, discard, merged, small_batches

#: Features of the distinct rows of the fit, added up, that the driver may hold; more are fitted as a table, by the same rule.
DRIVER_ENTRIES = 2_000_000
#: Words and stems that the classifier may weigh, at most: those that go best with the label.
FEATURES = 8192
#: Lengths of the stems that count as features beside whole words: what inflects shows by its stem.
STEMS = (3, 4, 5, 6, 7, 8)
#: Toxic rows of the sample that must hold a feature, and how far its toxic share must exceed that of all rows.
LEAST_HOLDERS, LEAST_LIFT = 3, 1.5
#: Penalties of the logistic fit.
L1, L2 = 0.02, 0.05
#: Of the features that stand in toxic rows more often than not, so many of the greatest ratio are also looked for where
#: only a skeleton hints at them (one doubled letter, a sign among single letters); stems of this length or more.
HIDDEN, LEAST_STEM = 256, 5
#: What a sign may stand for besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'`"
_A = 28  # a to z, any other letter, the edge of a word
_EDGE, _OTHER = 27, 26
_SPACED = re.compile(r"\s\S(?:[ \t]+\S){2,}(?=[\s.,;:!?])")
_WIDE = re.compile(r"[ \t]{2,}")
_REPEAT = re.compile(r"([^\W\d_])\1")
_LONG_REPEAT = re.compile(r"([^\W\d_])\1\1")
_PLAIN = re.compile(r"[^\W\d_]+")
_SLICE = 1 << 20
_LEET_CHARS = frozenset(LEET)
_EDGE_PUNCT = ".,;:?\"'()[]{}<>#%&=*~`-_/\\"
#: A sign's letter in a skeleton; i and l, which share signs, are one.
_SKELETON = str.maketrans({c: "i" if "l" in reads else reads for c, reads in LEET.items()} | {"l": "i"} | dict.fromkeys(SEPARATORS))
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_code = None


def _codes() -> np.ndarray:
    global _code
    if _code is None:
        _code = np.full(0x110000, _EDGE, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                _code[c] = _OTHER
        for i in range(26):
            _code[97 + i] = _code[65 + i] = i
    return _code


def trigrams(text: str | None) -> np.ndarray:
    """Counts of letter trigrams; an edge stands before and after each word."""
    total = np.zeros(_A**3, np.int64)
    for at in range(0, len(text or ""), _SLICE):
        c = _codes()[np.frombuffer(text[max(0, at - 2) : at + _SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        c = np.concatenate([[_EDGE, _EDGE], c, [_EDGE]]) if at == 0 else np.append(c, _EDGE)
        total += np.bincount((c[:-2] * _A + c[1:-1]) * _A + c[2:], minlength=_A**3)
    return total


def _count_pass(batches):
    total = np.zeros(_A**3, np.int64)
    for b in batches:
        for t in b.column(0):
            total += trigrams(t.as_py())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])


@dataclass
class Model:
    """log P(next | two before), the weight of each word and stem, the log-odds of a text without any, and the
    words and stems that are looked for behind every obfuscation."""

    lm: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    hidden: frozenset = frozenset()


def char_model(counts: np.ndarray, words: dict[str, float] | None = None) -> np.ndarray:
    """Trigram log-probabilities, interpolated with bigrams and unigrams; ``words`` add to the counts."""
    n3 = counts.reshape(_A, _A, _A).astype(np.float64) ** 0.75  # flatter: rare words still have a say
    for w, weight in (words or {}).items():
        c = [_EDGE, _EDGE, *_codes()[[ord(x) for x in w]].tolist(), _EDGE]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            n3[a, b, d] += weight
    n2 = n3.sum(0)
    n1 = n2.sum(0)
    p1 = (n1 + 1) / (n1 + 1).sum()
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return np.log((n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5))


def _options(s: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of one sign, what it may be read as, with the channel's log-probability."""
    out, i = [], 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        c, n = s[i], j - i
        reads = [(c, 0.0)] if c.isalpha() else [(x, -0.3) for x in LEET.get(c, "")]
        if n == 1:
            opts = list(reads)
        elif n == 2:
            opts = [(x + x, p) for x, p in reads] + [(x, p - 2.0) for x, p in reads]
        else:
            opts = [(x, p - 0.7) for x, p in reads] + [(x + x, p - 0.7) for x, p in reads]
        if not c.isalpha():
            opts.append(("", -0.5 if c in SEPARATORS or c.isspace() else -9.0))
        out.append(opts)
        i = j
    return out


def decode(s: str, lm: np.ndarray) -> str:
    """The likeliest reading of an obfuscated token, by Viterbi over the last two characters."""
    code = _codes()
    states = {(_EDGE, _EDGE): (0.0, None, "")}
    for opts in _options(s):
        new: dict = {}
        for (a, b), node in states.items():
            for text, p in opts:
                x, y, score = a, b, node[0] + p
                for ch in text:
                    z = int(code[ord(ch)])
                    score += lm[x, y, z]
                    x, y = y, z
                if (x, y) not in new or score > new[x, y][0]:
                    new[x, y] = (score, node, text)
        states = new
    node = max(((n[0] + lm[a, b, _EDGE], n) for (a, b), n in states.items()), key=lambda x: x[0])[1]
    out = []
    while node is not None:
        out.append(node[2])
        node = node[1]
    return "".join(reversed(out))


def skeleton(s: str) -> str:
    """Signs as their letters, runs as one; separators go."""
    return _RUN.sub(r"\1", s.translate(_SKELETON))


def features(word: str) -> list[str]:
    """What a restored word shows: itself, and its stems of a few lengths as ``^stem``."""
    return [word, *(f"^{word[:n]}" for n in STEMS if len(word) > n)]


class Restorer:
    """The features of a text's distinct words after deobfuscation. With ``keep``, only those in it; what a
    token shows is then remembered, up to a fixed number of tokens. ``hidden``: those of ``keep`` (all, if not
    given) that are also looked for where only a skeleton, or a run of single letters, hints at them."""

    def __init__(self, lm: np.ndarray, keep=None, hidden=None):
        self.lm, self.keep, self.memo, self.plain, self.read = lm, keep, {}, set(), {}
        hidden = (keep or frozenset()) if hidden is None else hidden
        self.kept_stems = {w[1:]: w for w in keep or () if w[0] == "^"}
        self.prefixes = {w[:n] for w in self.kept_stems for n in STEMS if n <= len(w)}
        self.inside = [w for w in hidden if w[0] != "^" and len(w) > 3]
        self.bare = {skeleton(w) for w in hidden if w[0] != "^"}
        self.stems = {skeleton(w[1:]) for w in hidden if w[0] == "^"}
        self.lengths = sorted({len(x) for x in self.stems})

    def may_hide(self, t: str) -> bool:
        """Whether a token has the skeleton of a hidden word, or begins with that of a stem."""
        s = skeleton(t)
        return s in self.bare or any(s[:n] in self.stems for n in self.lengths if n <= len(s))

    def decoded(self, t: str) -> str:
        """``decode``, remembered for a fixed number of short tokens."""
        if len(t) > 64:
            return decode(t, self.lm)
        if t not in self.read:
            if len(self.read) >= 50_000:
                self.read.clear()
            self.read[t] = decode(t, self.lm)
        return self.read[t]

    def token(self, t: str) -> set[str]:
        """A token's own words and, if it looks obfuscated, its likeliest reading."""
        t = t.strip(_EDGE_PUNCT)
        if t.isalpha():
            found = {t}
            if _REPEAT.search(t):
                if self.keep is None or _LONG_REPEAT.search(t) or self.may_hide(t):
                    found.add(self.decoded(t))
                if self.keep is not None and (once := _REPEAT.sub(r"\1", t)) in self.keep:
                    found.add(once)
            return found
        parts = _PLAIN.findall(t)
        found, letters = set(parts), sum(map(len, parts))
        signs = sum(map(t.count, _LEET_CHARS))
        if (len(parts) > 1 or signs) and letters + signs + sum(map(t.count, SEPARATORS)) == len(t) and (letters > 1 or self.may_hide(t)):
            found.add(self.decoded(t))
        return found

    def kept(self, word: str) -> list[str]:
        """Those of ``features(word)`` that are in ``keep``."""
        found = [word] if word in self.keep else []
        for n in STEMS:
            if len(word) <= n or word[:n] not in self.prefixes:
                break  # no longer stem begins so either
            if stem := self.kept_stems.get(word[:n]):
                found.append(stem)
        return found

    def shown(self, t: str) -> set[str]:
        if self.keep is None:
            found = {f for w in self.token(t) for f in features(w)}
            if len(t) <= 64:
                if len(self.memo) > 30_000:
                    self.memo.clear()
                self.memo[t] = tuple(found)
            return found
        found = {f for w in self.token(t) for f in self.kept(w)}
        if len(t) <= 64:
            if len(self.memo) + len(self.plain) > 150_000:
                self.memo.clear()
                self.plain.clear()
            if found:
                self.memo[t] = found
            else:
                self.plain.add(t)
        return found

    def words(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        found = set()
        for t in set(text.split()) - self.plain:
            found.update(self.memo.get(t) or self.shown(t))
        for m in _SPACED.finditer(f" {text} "):
            runs = _WIDE.split(m[0].strip())
            # wide blanks may stand between letters as well as between words
            for s in {"".join(m[0].split()), *("".join(r.split()) for r in runs if len(runs) > 1 and len(r) > 4)}:
                read = decode(s, self.lm)
                if self.keep is None:
                    found.update(features(read))
                else:
                    found.update(f for w in [*(w for w in self.inside if w in read), read] for f in self.kept(w))
        return found


def _runs(of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``of`` over runs of ``counts`` places."""
    out, full = np.zeros(len(counts)), np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(of, (np.cumsum(counts) - counts)[full])
    return out


def _off(z: np.ndarray, y: np.ndarray, times: np.ndarray, curved: bool) -> np.ndarray:
    """The slope of each row's loss at log-odds ``z``; of its greatest parabola, if not ``curved``."""
    return times * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) if curved else 0.25 * times * z


def _descended(back, size: int, hits: float, misses: float, l1: float, l2: float, rounds: int, turns: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the least loss, by accelerated proximal steps. ``back(w, b, curved)``: the sums of ``_off`` over the rows of
    each feature, and over all rows, where the rows' log-odds are those of ``w`` and ``b``."""
    w, b, t = np.zeros(size), math.log((hits + 0.5) / (misses + 0.5)), 1.0
    x, top = np.ones(size + 1), 1.0
    for _ in range(turns):  # the largest curvature
        x = back(x[:-1], x[-1], False)
        top = float(np.linalg.norm(x)) or 1.0
        x /= top
    step, v, c = 1 / (1.05 * top + l2), w, b
    for _ in range(rounds):
        slope = back(v, c, True)
        new = v - step * (slope[:-1] + l2 * v)
        new, new_b = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0), c - step * slope[-1]
        uphill = (v - new) @ (new - w) + (c - new_b) * (new_b - b) > 0  # start the momentum anew
        ahead = 1.0 if uphill else (1 + math.sqrt(1 + 4 * t * t)) / 2
        moved = max(float(np.abs(new - w).max(initial=0)), abs(new_b - b))
        v, c = new + (t - 1) / ahead * (new - w), new_b + (t - 1) / ahead * (new_b - b)
        w, b, t = new, float(new_b), ahead
        if moved < 1e-6:
            break
    return w, b


def logistic(rows: list[np.ndarray], y: np.ndarray, times: np.ndarray, size: int, l1: float = L1, l2: float = L2, rounds: int = 600, turns: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log-loss of ``rows`` (places of the features that each holds, of ``size``)
    with labels ``y``, each counted ``times`` times, plus l1 * |w| + l2 * w^2 / 2, by accelerated proximal
    steps. The same rows in any order give the same weights but for rounding."""
    col = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[np.argsort(col, kind="stable")]  # in order of their columns
    by_row, by_col = np.array([len(r) for r in rows], np.int64), np.bincount(col, minlength=size)

    def back(w, b, curved):
        off = _off(_runs(w[col], by_row) + b, y, times, curved)
        return np.append(_runs(off[row], by_col), off.sum())

    return _descended(back, size, float((times * y).sum()), float((times * (1 - y)).sum()), l1, l2, rounds, turns)


def _back_pass(shared):
    def run(batches):
        w, b, curved = shared.value
        total = np.zeros(len(w) + 1)
        for batch in batches:
            places, y, times = (batch.column(k) for k in range(3))
            col, by_row = places.flatten().to_numpy(zero_copy_only=False), np.diff(places.offsets.to_numpy())
            off = _off(_runs(w[col], by_row) + b, y.to_numpy(), times.to_numpy(), curved)
            total[:-1] += np.bincount(col, np.repeat(off, by_row), len(w))
            total[-1] += off.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def logistic_table(rows: DataFrame, size: int, l1: float = L1, l2: float = L2, rounds: int = 600, turns: int = 40) -> tuple[np.ndarray, float]:
    """``logistic`` of a written table ``places, y, times`` of any size: each step reads it once, and only sums by feature come back."""
    spark = rows.sparkSession

    def back(w, b, curved):
        shared = spark.sparkContext.broadcast((w, b, curved))
        parts = rows.mapInArrow(_back_pass(shared), "sums binary").repartition(4).mapInArrow(merged, "sums binary").collect()
        shared.destroy()
        return sum((np.frombuffer(r.sums) for r in parts), np.zeros(size + 1))

    hits, all_of = rows.agg(F.sum(F.col("times") * F.col("y")), F.sum("times")).first()
    return _descended(back, size, hits, all_of - hits, l1, l2, rounds, turns)


def _holders_pass(shared, most: int = 300_000):
    """Per feature the toxic shares of its texts, added up, and how many texts; partial sums of at most ``most`` features at a time."""

    def batch(a: dict, m: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(m), pa.string()), pa.array([a.get(w, 0.0) for w in m], pa.float64()), pa.array(list(m.values()), pa.int64())], names=["word", "a", "m"])

    def run(batches):
        r, a, m = Restorer(shared.value), {}, Counter()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                found = r.words(t.as_py())
                m.update(found)
                if y:
                    for w in found:
                        a[w] = a.get(w, 0.0) + y
                if len(m) > most:
                    yield batch(a, m)
                    a, m = {}, Counter()
        yield batch(a, m)

    return run


def _places_pass(shared):
    def run(batches):
        lm, names, hidden = shared.value
        r, place = Restorer(lm, frozenset(names), hidden), {w: i for i, w in enumerate(names)}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(place[w] for w in r.words(t.as_py())) for t in b.column(2)], pa.list_(pa.int32()))], names=["toxic", "copies", "places"])

    return run


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs.join(ids, "_doc")``. A bitmap of the ids, two bits for each, drops most other rows of ``docs`` before any is moved."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bitmap(spark, ids.select(F.xxhash64("_doc").alias("h"))).tobytes())

    @F.arrow_udf("boolean")
    def found(h: pa.Array) -> pa.Array:
        return pa.array(_in_bitmap(np.frombuffer(shared.value, np.uint64), h.to_numpy().view(np.uint64)))

    return docs.where(found(F.xxhash64("_doc"))).join(ids, "_doc")


def _learnt(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``toxic, copies, text``, written: each different text that an id of ``known`` (``_id, toxic``) has in ``docs`` (``_doc, text``),
    of an id with several the greatest; the mean label and the number of its ids.

    Ids and texts are matched by digests; one text of each digest is moved, and all texts of an id with several."""
    digest = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(bytearray())).alias("h")
    same = F.col("_doc") == F.col("_id")
    each = cut(docs.select("_doc", digest).join(known, same).groupBy("_id", "toxic").agg(F.min("_doc").alias("_doc"), F.min("h").alias("h"), F.max("h").alias("other")), "digests")
    made, several = [each], each.where("h <> other").select("_id", "toxic")
    with small_batches(docs.sparkSession):
        if not several.isEmpty():
            made.append(cut(docs.select("_doc").join(several, same).distinct(), "several"))
            top = _texts_of(docs, made[-1]).groupBy("_id", "toxic").agg(F.max(F.struct("text", "_doc")).alias("top"))
            made.append(cut(top.select("toxic", "top.*").select("toxic", "_doc", digest), "greatest"))
            each = each.where("h = other").select("toxic", "_doc", "h").unionByName(made[-1])
        made.append(cut(each.groupBy("h").agg(F.min("_doc").alias("_doc"), F.avg("toxic").alias("toxic"), F.count("*").alias("copies")).drop("h"), "texts"))
        learnt = cut(_texts_of(docs, made[-1]).groupBy("_doc", "toxic", "copies").agg(F.max("text").alias("text")).drop("_doc"), "labelled")
    for x in made:
        discard(x)
    return learnt


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FEATURES, driver_entries: int = DRIVER_ENTRIES) -> Model:
    """The character model counts every text of ``docs``. The weights come from every labelled
    id where ``learn`` holds (one text for each id, the greatest), over at most ``most`` words
    and stems, those of the greatest log-likelihood ratio with the label. Equal texts are one row of the
    fit, of weight 1 + log(copies) and with the mean of their labels, so that a text of many copies
    doesn't decide alone. Rows of the same features are added up, which leaves the loss as it is; the driver fits them
    if they hold at most ``driver_entries`` features in all, else they are fitted as a table, by the same rule.

    An id with both labels counts as toxic; null ids and labels teach nothing. Without a labelled text every
    text scores 0; with labels of one kind only, about the share of that kind (one half added to each kind).
    """
    spark = docs.sparkSession
    with small_batches(spark):
        grams = cut(docs.select(F.col(text_col).alias("text")).mapInArrow(_count_pass, "at int, n bigint"), "trigrams")
    rows = grams.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    discard(grams)
    counts = np.zeros(_A**3, np.int64)
    counts[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    lm = char_model(counts)

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    learnt = _learnt(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")), known)

    total = learnt.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("k")).first()
    n, k = total.n, total.k
    if k in (0, n):
        discard(learnt)
        return Model(lm, {}, math.log((k + 0.5) / (n - k + 0.5)) if n else -math.inf)
    a, m = F.col("a"), F.col("m")

    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    g2 = 2 * (part(a, m * k / n) + part(m - a, m * (n - k) / n) + part(F.lit(k) - a, (n - m) * k / n) + part(n - m - k + a, (n - m) * (n - k) / n))
    with small_batches(spark):
        got = cut(learnt.mapInArrow(_holders_pass(spark.sparkContext.broadcast(lm)), "word string, a double, m bigint"), "holders")
    by_word = got.groupBy("word").agg(F.sum("a").alias("a"), F.sum("m").alias("m"))
    likely = by_word.where((a >= LEAST_HOLDERS) & (a * n > LEAST_LIFT * k * m) & (F.length("word") > 2)).withColumn("g2", g2)
    best = likely.orderBy(F.desc("g2"), "word").limit(most).collect()  # at most ``most``
    discard(got)
    names = [r.word for r in best]
    hidden = frozenset([r.word for r in best if 2 * r.a > r.m and (r.word[0] != "^" or len(r.word) > LEAST_STEM)][:HIDDEN])
    lm = char_model(counts, {f.removeprefix("^"): 1e-4 * float(counts.sum()) ** 0.75 for f in hidden})
    # once more, as the score will see them
    with small_batches(spark):
        got = cut(learnt.mapInArrow(_places_pass(spark.sparkContext.broadcast((lm, names, hidden))), "toxic double, copies bigint, places array<int>"), "features")
    discard(learnt)
    times = 1 + F.log(F.col("copies").cast("double"))
    held = cut(got.groupBy("places").agg(F.sum(times).alias("times"), (F.sum(times * F.col("toxic")) / F.sum(times)).alias("y")).select("places", "y", "times"), "rows")
    discard(got)
    if held.agg(F.sum(F.size("places") + 1)).first()[0] <= driver_entries:
        here = held.toPandas()
        sets = [np.asarray(x, np.int32) for x in here["places"]]
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())  # the same at any partitioning
        w, bias = logistic([sets[i] for i in order], here["y"].to_numpy(float)[order], here["times"].to_numpy(float)[order], len(names))
    else:
        w, bias = logistic_table(held, len(names))
    discard(held)
    return Model(lm, {names[i]: float(w[i]) for i in np.flatnonzero(w)}, bias, hidden)


class Scorer:
    """1 / (1 + exp(-(bias + the weights of the features that the restored text shows)))."""

    def __init__(self, model: Model):
        self.model, self.restorer = model, Restorer(model.lm, frozenset(model.weights), model.hidden)

    def one(self, text: str | None) -> float:
        z = self.model.bias + math.fsum(self.model.weights[f] for f in self.restorer.words(text))
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0

    def __call__(self, texts) -> np.ndarray:
        return np.array([self.one(t.as_py()) for t in texts], float)


def _score_pass(shared):
    def run(batches):
        score = Scorer(shared.value)
        for b in batches:
            out = score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def _keep_pass(shared, at: int, below: float):
    def run(batches):
        score = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(score(b.column(at)) < below))

    return run


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, that score under ``below``, as a written table; no row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    with small_batches(docs.sparkSession):
        return cut(docs.mapInArrow(_keep_pass(shared, docs.columns.index(text_col), below), docs.schema), "clean")


def predict(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    The score is the logistic function of the bias and the weights of the words and stems that the restored
    text shows, each once; null and empty texts get that of the bias alone. Repeated rows score alike; an empty table
    gives an empty result; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    with small_batches(docs.sparkSession):
        return cut(src.mapInArrow(_score_pass(shared), f"doc_id {kind}, held_out boolean, score double, predicted int"), "scores")

"""Language identification: normalised TF-IDF n-gram vectors, several clustered centroids per language,
nearest by cosine, with distance-based rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.scratch import cut, discard

DIM, GRAMS = 1 << 13, 3
#: Labelled rows that the clustering may use, for all languages together, and for one.
SAMPLE, SAMPLE_EACH = 6000, 400
CENTROIDS = 4
UNKNOWN = "und"
_SLICE = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's character n-grams of 1 to 3 occur; None without a letter. Letters are
    lower-cased, any run of others is one space; long texts are taken in slices that overlap."""
    total, tail, letter, any_letter = np.zeros(DIM, np.int64), np.array([32], np.uint32), _is_letter(), False
    text = text or ""
    for at in range(0, len(text), _SLICE):
        c = np.frombuffer(text[at : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = letter[c]
        any_letter |= bool(ok.any())
        c = np.where(ok, c, 32)
        c = c[ok | np.concatenate([[tail[-1] != 32], ok[:-1]])]
        c = np.concatenate([tail, c])
        old = len(tail)
        one = (c.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        x = one
        for n in range(GRAMS):
            if n:  # x[i]: the n + 1 characters that end at i + n
                x = x[:-1] * _MIX[1] + one[n:]
            y = x[max(0, old - n) :]  # those that end in this slice
            total += np.bincount(((y ^ (y >> np.uint64(15))) * _MIX[2] >> np.uint64(12)).astype(np.int64) & (DIM - 1), minlength=DIM)
        tail = c[-GRAMS:]
    return total if any_letter else None


@dataclass
class Model:
    """Unit centroids by row, their languages, the cosine below which each rejects, and the IDF."""

    centroids: np.ndarray
    langs: list[str]
    reject: np.ndarray
    idf: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0).astype(np.float32) * idf)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; the same rows always give the same centroids."""
    seeds = [_unit(x.mean(0))]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin(np.max(x @ np.array(seeds).T, axis=1))])
    c = np.array(seeds)
    for _ in range(12):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([_unit(x[own == j].mean(0)) if (own == j).any() else c[j] for j in range(len(c))])
    near = x @ c.T
    own = np.argmax(near, axis=1)
    reject = np.array([0.7 * np.quantile(near[own == j, j], 0.01) if (own == j).any() else 1.0 for j in range(len(c))])
    return c, reject


def _learn_pass(cutoff: dict[str, float]):
    """Document frequencies of a task's rows (kind 0), how many rows there are (kind 2), and the vectors of those whose hash is
    within their language's cutoff (kind 1)."""

    def batch(kind, lang, h, at, n):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(lang, pa.string()), pa.array(h, pa.float64()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))], names=["kind", "lang", "h", "at", "n"])

    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            out = []
            for text, lang, h in zip(*(b.column(k) for k in range(3)), strict=True):
                c = counts(text.as_py())
                if c is None:
                    continue
                df += c > 0
                n += 1
                if h.as_py() <= cutoff.get(lang.as_py(), -1.0):
                    at = np.flatnonzero(c)
                    out.append((1, lang.as_py(), h.as_py(), at.astype(np.int32), c[at]))
            if out:
                yield batch(*map(list, zip(*out, strict=True)))
        if n:
            yield batch([0, 2], ["", ""], [0.0, 0.0], [np.arange(DIM, dtype=np.int32), np.zeros(1, np.int32)], [df, np.array([n])])

    return run


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, each: int = SAMPLE_EACH) -> Model | None:
    """Learn from the rows where ``learn`` holds and the language is not null. IDF counts all of them; the
    clusters use at most ``each`` ids of a language and ``sample`` in all, the first by a hash of the id; of rows that
    repeat an id and language, one (the greatest vector). Of more than ``sample`` languages, the ``sample`` with the most ids are
    learnt. None if there is nothing to learn from."""
    known = docs.where(learn & F.col(lang_col).isNotNull())
    h = ((F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)).alias("h")
    # ids are counted roughly: a repeated id must not make its language's share of the sample smaller
    sizes = known.groupBy(F.col(lang_col).alias("lang")).agg(F.approx_count_distinct(id_col).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    if not sizes:
        return None
    each = max(1, min(each, sample // len(sizes)))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2.0 * each + 20) / max(1, r.n))) for r in sizes], "_lang string, _share double")  # at most ``sample`` rows
    first = known.select(F.col(lang_col).alias("lang"), h).join(F.broadcast(share), F.col("lang") == F.col("_lang")).where("h < _share").select("lang", "h").distinct()
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    cutoff = {r.lang: r.h for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    rows = known.where(F.col(text_col).isNotNull())
    got = cut(rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), h).mapInArrow(_learn_pass(cutoff), "kind int, lang string, h double, at array<int>, n array<bigint>"), "langid")
    df = got.where("kind = 0").select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).toPandas()
    docs_n = got.where("kind = 2").agg(F.sum(F.col("n")[0])).first()[0]
    if not docs_n:
        return None
    idf = np.zeros(DIM, np.float32)
    idf[df["at"].to_numpy()] = np.log((1 + docs_n) / (1 + df["n"].to_numpy(np.float64))) + 0.1
    picked = got.where("kind = 1").groupBy("lang", "h").agg(F.max(F.struct("at", "n")).alias("x")).select("lang", "h", "x.at", "x.n").orderBy("lang", "h").toPandas()  # at most ``sample`` rows
    discard(got)
    centroids, langs, reject = [], [], []
    for lang, own in picked.groupby("lang", sort=True):
        x = np.zeros((len(own), DIM), np.float32)
        for i, (at, n) in enumerate(zip(own["at"], own["n"], strict=True)):
            x[i, at] = n
        c, r = _clusters(vectors(x, idf), CENTROIDS)
        centroids.append(c)
        reject.append(r)
        langs += [lang] * len(c)
    if not langs:
        return None
    return Model(np.concatenate(centroids).astype(np.float32), langs, np.concatenate(reject), idf)


def _predict(shared):
    def run(batches):
        m: Model | None = shared.value
        for b in batches:
            texts, n = b.column(2), b.num_rows
            lang, score, far = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            for a in range(0, n, 128):
                rows, where = [], []
                for k in range(a, min(a + 128, n)):
                    c = counts(texts[k].as_py()) if m is not None else None
                    if c is not None:
                        rows.append(c)
                        where.append(k)
                if rows:
                    near = vectors(np.array(rows), m.idf) @ m.centroids.T
                    best = np.argmax(near, axis=1)
                    for k, j, s in zip(where, best, near[np.arange(len(best)), best], strict=True):
                        lang[k], score[k], far[k] = m.langs[j], min(1.0, max(0.0, float(s))), s < m.reject[j]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, rejected``.

    ``lang_pred`` is the language of the nearest centroid and ``score`` its cosine; it is ``und`` with
    score 0 for a null text, one without a letter, or an empty model. ``rejected``: the text is
    farther from that centroid than the centroid's own training texts (take such rows as unknown).
    Ties go to the first language by name. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")

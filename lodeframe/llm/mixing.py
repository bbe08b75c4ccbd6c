"""Mixing sources to target weights: iterative proportional fitting over a table of cells, then sampling of
documents by calibrated probabilities."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import topics
from lodeframe.llm.scratch import cut, discard, small_batches

#: Cells that the driver may rake by itself, and that may be broadcast; more are raked as a table and joined by a salted shuffle.
DRIVER_CELLS = 50_000
#: Raking stops when no marginal share is off by more than TOLERANCE, or after ROUNDS rounds.
ROUNDS, TOLERANCE = 500, 1e-6
NONE = "∅"


def n_tokens(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """``value, share``: the marginal's shares once each cell's tokens are raised to ``power`` (1: as they are). The targets of several
    dimensions can then always be met together, however closely the dimensions go with each other."""
    sums = cells.where("tokens > 0").groupBy(F.col(dim).alias("value")).agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))).alias("w"))
    return sums.select("value", (F.col("w") / F.lit(sums.agg(F.sum("w")).first()[0] or 1.0)).alias("share"))


def rake_arrays(index: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights of cells whose sums over each dimension match its targets (shares of the total), and by how much
    the worst share is off in them."""
    w = tokens.astype(np.float64) / max(tokens.sum(), 1)

    def off() -> float:
        return max((float(np.abs(np.bincount(at, w, len(share)) - share).max(initial=0)) for at, share in zip(index, targets, strict=True)), default=0.0)

    for _ in range(rounds):
        if off() <= tolerance:
            break
        for at, share in zip(index, targets, strict=True):
            now = np.bincount(at, w, len(share))
            w = w * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[at]
    return w, off()


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, float]:
    """``cells(*dims, tokens)`` -> the cells with ``weight``, each one's share of the mixture, and the residual: how far the
    worst share of a marginal is from its target in the end. Targets that contradict each other, or cells that
    lack, leave a residual over ``tolerance``.

    Values of a dimension without a target get none; target shares of values that no cell has
    are spread over the others in proportion. Up to ``driver_cells`` cells are raked by the driver in
    arrays; any more as a table, one written table a round, by the same rule.
    """
    spark = cells.sparkSession
    fit = {}
    for d in dims:
        have = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        t = targets[d].join(have, "value").groupBy("value").agg(F.sum("share").alias("share"))
        fit[d] = t.select("value", (F.col("share") / F.lit(t.agg(F.sum("share")).first()[0] or 1.0)).alias("share"))
    if cells.count() <= driver_cells:
        pdf = cells.toPandas()
        index, shares = [], []
        for d in dims:
            share = {r["value"]: r["share"] for r in fit[d].collect()}
            values = sorted(set(pdf[d]))
            place = {v: i for i, v in enumerate(values)}
            index.append(pdf[d].map(place).to_numpy(np.int64) if len(pdf) else np.zeros(0, np.int64))
            shares.append(np.array([share.get(v, 0.0) for v in values]))
        pdf["weight"], residual = rake_arrays(index, pdf["tokens"].to_numpy(np.float64), shares, rounds, tolerance) if len(pdf) else ([], 0.0)
        schema = ", ".join([f"`{d}` string" for d in dims] + ["tokens bigint", "weight double"])
        return spark.createDataFrame(pdf.values.tolist(), schema), residual
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cut(cells.select(*dims, "tokens", (F.col("tokens") / F.lit(float(total))).alias("weight")), "cells")

    def sums(df, d):
        return df.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("s")).join(fit[d], "value", "left").select("value", "s", F.coalesce("share", F.lit(0.0)).alias("share"))

    def off() -> float:
        return reduce(lambda a, b: a.unionByName(b), (sums(now, d).select(F.abs(F.col("s") - F.col("share")).alias("x")) for d in dims)).agg(F.max("x")).first()[0] or 0.0

    residual = off()
    for _ in range(rounds):
        if residual <= tolerance:
            break
        step = now
        for d in dims:
            factor = sums(step, d).select(F.col("value").alias(d), F.when(F.col("s") > 0, F.col("share") / F.col("s")).otherwise(0.0).alias("f"))
            step = step.join(factor, d).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        nxt = cut(step.select(*dims, "tokens", "weight"), "cells")
        discard(now)
        now = nxt
        residual = off()
    return now, residual


def _scale(cells: DataFrame, slack: float) -> float:
    """The largest constant by which the factors of ``cells(weight, _factor)`` become probabilities while those cut off at 1 take at most
    ``slack`` of the weight off; found by trying 64 constants at a time, so the cells stay where they are."""
    cells = cells.where("_factor > 0")
    most, least = cells.agg(F.max("_factor"), F.min("_factor")).first()
    if most is None:
        return 1.0
    low, high = 1.0 / most, 1.0 / least
    if slack <= 0:
        return low
    for _ in range(4):
        tries = np.geomspace(low, high, 64)
        lost = cells.agg(*[F.sum(F.col("weight") * F.greatest(F.lit(0.0), 1 - 1 / (F.col("_factor") * float(x)))) for x in tries]).first()
        good = [x for x, y in zip(tries, lost, strict=True) if y <= slack]
        low, high = (good[-1] if good else low), next((x for x in tries if not good or x > good[-1]), high)
    return float(low)


def _with_weights(rows: DataFrame, factor: DataFrame, names: list[str], few: bool) -> DataFrame:
    """``rows`` with their cell's weight: no row moves if the cells are ``few``; else each cell's rows are dealt out over
    as many keys as there are shuffle partitions, so that no cell is too large for a task."""
    if few:
        return rows.join(F.broadcast(factor), names, "left")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    return salted.join(factor.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))), [*names, "_salt"], "left").drop("_salt")


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.8, keep: float | None = None, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, seed: int = 17, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """One row per input row: ``doc_id, source, lang, topic, n_tokens, weight, probability, selected, residual``.

    ``weight`` is the factor by which a token of the row's cell counts for more or less than in the input
    (1: as it is; 0 for rows without tokens). ``probability`` is weight times the largest constant that
    keeps all at most 1, so that the expected tokens of the sample have the target marginals; with
    ``keep``, that share of all tokens is aimed at instead, and what would pass 1 stops there. With ``slack``, the constant is as large as
    it can be while what stops at 1 takes no more than that share off the mixture: so a few stray documents, whose cell is raised
    most, don't decide how much of all others is kept.
    ``selected``: a hash of id and seed falls below it, so the same rows are chosen at any
    partitioning. ``targets``: dimension -> (value, share); a dimension without one gets its
    share in the cells when their tokens are raised to ``power``. ``residual``, the same in all rows, is how far the worst share of a marginal stays from its target:
    over 1e-6 only where targets and cells cannot be met together.

    Dimensions are source, language and topic, a cluster of the text's words (``topics``, learnt from every text), unless ``dims`` gives others as
    columns. A null value of a dimension is a value of its own (``∅``); rows with a null id
    hash as an empty one. Repeated rows stand or fall together. An empty table gives an empty result; other columns are not read.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    own = dims or {"source": F.col("source"), "lang": F.col("lang")}
    values = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(d) for d, c in own.items()]
    if dims is None:
        with small_batches(spark):
            words = cut(topics.counted(docs.select(F.col(id_col).alias("doc_id"), *values, text.alias("_text")), "_text"), "words")
            rows = cut(topics.placed(words, topics.fit_counted(words)), "tokens")
        discard(words)
        names = [*own, "topic"]
    else:
        rows = cut(docs.select(F.col(id_col).alias("doc_id"), *values, n_tokens(text).alias("n_tokens")), "tokens")
        names = list(own)
    cells = cut(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "cells")
    given = targets or {}
    goal = {d: given[d] if d in given else tempered(cells, d, power) for d in names}
    fitted, residual = rake(cells, names, goal, driver_cells=driver_cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    factor = fitted.select(*names, F.when(F.col("tokens") > 0, F.col("weight") * float(total) / F.col("tokens")).otherwise(0.0).alias("weight"))
    scale = _scale(fitted.join(factor.withColumnRenamed("weight", "_factor"), names), slack) if keep is None else keep
    share = F.least(F.lit(1.0), F.col("weight") * scale)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    weighted = _with_weights(rows, factor, names, cells.count() <= driver_cells)
    return weighted.select("doc_id", *names, "n_tokens", "weight", share.alias("probability"), (draw < share).alias("selected"), F.lit(float(residual)).alias("residual"))


def sampled(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``mixed`` selects. Rows that repeat an id stay or go together: they stay
    if any of them is selected."""
    chosen = mixed(docs, id_col=id_col, **options).where("selected").select(F.col("doc_id").alias("_lodeframe_chosen")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(F.col("_lodeframe_chosen")), "left_semi")

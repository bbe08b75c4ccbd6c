"""Joins of all types, with equality, null-safe, mixed and purely conditional predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import expressions as E

_HOW = {"inner": "inner", "left": "left", "left_semi": "left_semi", "left_anti": "left_anti", "full": "full", "single": "left", "cross": "inner"}
#: A hinted broadcast is only followed up to this size of the side's rows in memory; the driver holds about three times as much.
BROADCAST_LIMIT = 64 << 20


def measured_bytes(df: DataFrame) -> int:
    """The size of a hash table of the rows, from their number and the lengths of their values (one pass over ``df``)."""
    sizes = [F.lit(64 + 8 * len(df.columns))]
    for name, field in zip(df.columns, df.schema, strict=True):
        c = F.col(f"`{name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(F.struct(c))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
    return df.agg(F.sum(reduce(add, sizes).cast("bigint"))).first()[0] or 0


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """``broadcast(df)`` if its measured size is within the limit, else ``df`` for a sort-merge join. Catalyst's estimate is
    of compressed files, so it can only refuse."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_LIMIT and measured_bytes(df) <= BROADCAST_LIMIT else df.hint("merge")


def _equated(e: E.Expr, n_left: int) -> list[int] | None:
    """The right columns of a condition that is only column equalities between the sides, else None."""
    if isinstance(e, E.Binary) and e.op == "and":
        a, b = _equated(e.left, n_left), _equated(e.right, n_left)
        return None if a is None or b is None else sorted({*a, *b})
    if isinstance(e, E.Binary) and e.op in ("=", "<=>") and isinstance(e.left, E.Ref) and isinstance(e.right, E.Ref):
        a, b = sorted((e.left.index, e.right.index))
        if a < n_left <= b:
            return [b - n_left]
    return None


#: About so many rows of a key from either side meet in one cell of a mixed join.
CELL = 2048
_FLIPPED = {"=": "=", "<=>": "<=>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class _Mixed:
    """Equalities between the sides and one comparison, as (operator, left, right), and conditions on one side."""

    equal: list[tuple[str, E.Expr, E.Expr]]
    compared: tuple[str, E.Expr, E.Expr]
    own: tuple[list[E.Expr], list[E.Expr]]


def _parts(e: E.Expr) -> list[E.Expr]:
    return _parts(e.left) + _parts(e.right) if isinstance(e, E.Binary) and e.op == "and" else [e]


def _mixed(condition: E.Expr, n_left: int, columns: list[Column], types: list[T.DataType]) -> _Mixed | None:
    """``condition`` taken apart if it is of that form, with keys of one type and values that compare as they sort."""

    def side(e):
        return {i >= n_left for i in E.refs(e)}

    equal, compared, own = [], [], ([], [])
    for part in _parts(condition):
        if len(side(part)) == 1:
            own[True in side(part)].append(part)
            continue
        if not isinstance(part, E.Binary) or part.op not in _FLIPPED:
            return None
        op, x, y = part.op, part.left, part.right
        if (side(x), side(y)) == ({True}, {False}):
            op, x, y = _FLIPPED[op], y, x
        if (side(x), side(y)) != ({False}, {True}):
            return None
        a, b = (E.compile(z, columns, types)[1] for z in (x, y))
        if op in ("=", "<=>"):
            if a != b or not isinstance(a, T.AtomicType):
                return None
            equal.append((op, x, y))
        else:
            if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType) or a == b and isinstance(a, (T.DateType, T.TimestampType, T.StringType))):
                return None
            compared.append((op, x, y))
    return _Mixed(equal, compared[0], own) if equal and len(compared) == 1 else None


def _mixed_join(a: DataFrame, b: DataFrame, m: _Mixed, how: str, types: list[T.DataType]) -> DataFrame:
    """A join whose keys may be few and hot. Whether a row has any match is a comparison with the other side's least or
    greatest value of its key. For the pairs, the rows of a key are dealt by their hash into groups of about CELL on
    either side, and each two groups meet in a cell of their own: copies of a row grow with the other side's groups only.
    Rows without a match are added to the pairs. Both sides are read more than once but by semi and anti joins."""
    names, (op, x, y) = (a.columns, b.columns), m.compared
    cols = [F.col(c) for c in [*names[0], *names[1]]]

    def value(e):
        return E.compile(e, cols, types)[0]

    def same(k, own, other):
        return reduce(and_, [F.col(f"{own}{i}").eqNullSafe(F.col(f"{other}{i}")) if o == "<=>" else F.col(f"{own}{i}") == F.col(f"{other}{i}") for i, o in enumerate(k)])

    def compare(u, v):
        return {"<": u < v, "<=": u <= v, ">": u > v, ">=": u >= v}[op]

    ops = [o for o, _, _ in m.equal]
    sides = []
    for df, s, v, own in ((a, 0, x, m.own[0]), (b, 1, y, m.own[1])):
        keys = [value(k[1 + s]).alias(f"_k{s}_{i}") for i, k in enumerate(m.equal)]
        ok = F.coalesce(reduce(and_, [value(e) for e in own]), F.lit(False)) if own else F.lit(True)
        sides.append(df.select("*", *keys, value(v).alias(f"_v{s}"), ok.alias(f"_ok{s}")))
    left, right = sides
    least = op in (">", ">=")  # of the right; of the left, the greatest then
    best = ((F.max, F.min) if least else (F.min, F.max))

    if how in ("left_semi", "left_anti"):
        most = right.where("_ok1").groupBy(*[F.col(f"_k1_{i}").alias(f"_k_{i}") for i in range(len(ops))]).agg(best[1]("_v1").alias("_best"))
        return left.join(most, same(ops, "_k0_", "_k_") & F.col("_ok0") & compare(F.col("_v0"), F.col("_best")), how).select(*names[0])

    def keyed(df, s):
        other = 1 - s
        return df.where(f"_ok{s} AND _v{s} IS NOT NULL").select(
            *[F.col(f"_k{s}_{i}").alias(f"_k_{i}") for i in range(len(ops))],
            F.col(f"_v{s}").alias(f"_v{s}"), F.lit(None).cast(sides[other].schema[f"_v{other}"].dataType).alias(f"_v{other}"), F.lit(s).alias("_s"),
        )

    groups = [F.ceil(F.count(F.when(F.col("_s") == s, True)) / CELL).cast("int").alias(f"_n{s}") for s in (0, 1)]
    sizes = keyed(left, 0).unionByName(keyed(right, 1)).groupBy(*[f"_k_{i}" for i in range(len(ops))]).agg(*groups, *[best[s](f"_v{s}").alias(f"_b{s}") for s in (0, 1)]).where("_n0 > 0 AND _n1 > 0")

    def marked(df, s, kept):
        """The rows, whether each has a match (``_m``), and how many groups its key has on either side; those without a partner's key if kept."""
        match = compare(F.col("_v0"), F.col("_b1")) if s == 0 else compare(F.col("_b0"), F.col("_v1"))
        return df.join(sizes, same(ops, f"_k{s}_", "_k_"), "left" if kept else "inner").withColumn("_m", F.coalesce(F.col(f"_ok{s}") & match, F.lit(False)))

    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df, s):
        """Each row that has a match, once for each group of the other side. The partitions are fixed, as pairs cost more than bytes."""
        plain = [F.col(c) for c, f in zip(df.columns, df.schema, strict=True) if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        df = marked(df.withColumn("_h", F.xxhash64(*plain)), s, False).where("_m")
        keys = [f"_k{s}_{i}" for i in range(len(ops))]
        mine, theirs = F.pmod("_h", F.col(f"_n{s}").cast("bigint")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"_n{1 - s}") - 1))
        return df.select(*names[s], *keys, f"_v{s}", mine.alias(f"_g{s}_{s}"), theirs.alias(f"_g{s}_{1 - s}")).repartition(parts, *keys, f"_g{s}_0", f"_g{s}_1")

    def alone(df, s):
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in (b, a)[s].schema]
        return marked(df, s, True).where("NOT _m").select(*names[s], *nulls).select(*names[0], *names[1])

    on = same(ops, "_k0_", "_k1_") & (F.col("_g0_0") == F.col("_g1_0")) & (F.col("_g0_1") == F.col("_g1_1")) & compare(F.col("_v0"), F.col("_v1"))
    out = dealt(left, 0).join(dealt(right, 1).hint("merge"), on).select(*names[0], *names[1])
    for s in {"left": (0,), "full": (0, 1)}.get(how, ()):
        out = out.unionByName(alone(sides[s], s))
    return out


def _rereadable(df: DataFrame) -> bool:
    """Whether reading ``df`` twice surely gives the same rows: scans, filters, projections and unions without chance."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = (line.lstrip(" :+-").split(" ")[0] for line in plan.treeString().splitlines())
    return plan.deterministic() and all(x in ("Relation", "LogicalRDD", "LocalRelation", "Range", "Project", "Filter", "Union", "Repartition", "RepartitionByExpression", "Sort") for x in nodes)


def join_frames(left: DataFrame, right: DataFrame, condition: E.Expr, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join on an expression whose ordinals count the left columns, then the right ones.

    Rows whose keys are null never match under ``=`` (an anti join keeps them) and match each other
    under ``<=>``. ``single`` is a left join that raises if a left row has two matches. A hint may name the side to broadcast, which its size must allow,
    or ``shuffle``. Without a hint, equalities with one comparison between the sides are joined in cells
    (``_mixed_join``) if both sides can be read twice; semi and anti joins need the least or greatest value of a key only.
    """
    if how not in _HOW:
        raise ValueError(f"unknown join type {how!r}")
    n = len(left.columns)
    l_names = [f"_l{i}" for i in range(n)]
    r_names = [f"_r{i}" for i in range(len(right.columns))]
    a, b = left.toDF(*l_names), right.toDF(*r_names)
    types = [f.dataType for f in left.schema] + [f.dataType for f in right.schema]
    on, _ = E.compile(condition, [F.col(c) for c in l_names + r_names], types)
    keys = _equated(condition, n) if how == "single" else None
    if keys:  # a second match can only come from a key that repeats on the right: find those there
        rest = [c for c in r_names if c not in {f"_r{k}" for k in keys}]
        b = b.groupBy(*[f"_r{k}" for k in keys]).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    elif how == "single":
        a = a.withColumn("_row", F.monotonically_increasing_id())
    if hint == "broadcast_left":
        a = bounded_broadcast(a)
    elif hint == "broadcast_right":
        b = bounded_broadcast(b)
    elif hint == "shuffle":
        b = b.hint("shuffle_hash")
    elif hint is not None:
        raise ValueError(f"unknown join hint {hint!r}")
    mixed = _mixed(condition, n, [F.col(c) for c in l_names + r_names], types) if how != "single" and hint is None else None
    if mixed and (how in ("left_semi", "left_anti") or _rereadable(a) and _rereadable(b)):
        out = _mixed_join(a, b, mixed, _HOW[how], types)
    else:
        out = a.join(b, on, _HOW[how])
    if how == "single":
        if not keys:
            out = out.groupBy("_row", *l_names).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in r_names])
        # a second match raises, as a scalar subquery's second row would, whatever columns are used later: a filter
        # is never pruned, and assert_true gives null where it holds
        once = F.assert_true(F.col("_n").isNull() | (F.col("_n") <= 1), "a single join found more than one match")
        out = out.where(once.isNull()).select(*l_names, *r_names)
    names = list(left.columns) if how in ("left_semi", "left_anti") else [*left.columns, *right.columns]
    seen: dict[str, int] = {}
    final = []
    for x in names:
        k = seen[x] = seen.get(x, -1) + 1
        final.append(x if not k else f"{x}_{k}")
    return out.toDF(*final)

"""Logical relations to DataFrames. Each node is one declarative step; Catalyst plans the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import expressions as E
from lodeframe.operators.aggregates import PLACES, aggregate_column
from lodeframe.operators.joins import join_frames
from lodeframe.operators.windows import window_column
from lodeframe.plans import relations as R


def columns_of(df: DataFrame) -> list:
    return [df[f"`{c}`"] for c in df.columns]


def types_of(df: DataFrame) -> list[T.DataType]:
    return [f.dataType for f in df.schema]


def unique_names(names) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n] = seen.get(n, -1) + 1
        out.append(n if not k else f"{n}_{k}")
    return out


def compile_plan(plan: R.Relation, table_of) -> DataFrame:
    """``table_of(name)`` gives a table's DataFrame; a Write calls ``table_of.write(name, df)``. Equal sub-plans
    compile to one DataFrame, so Spark can reuse their exchanges."""
    memo: dict = {}

    def value(e, df, subqueries=()):
        return E.compile(e, columns_of(df), types_of(df), subqueries)

    def filtered(df: DataFrame, condition: E.Expr, subqueries) -> DataFrame:
        """A filter whose IN (subquery) conjuncts become semi joins; Spark prunes partitions by them."""
        rest: E.Expr | None = None
        for part in conjuncts(condition):
            if isinstance(part, E.InSubquery):
                other = subqueries[part.relation]
                key = other.select(other[f"`{other.columns[0]}`"].alias("_lodeframe_in")).distinct()
                df = df.join(key, value(part.needle, df)[0] == F.col("_lodeframe_in"), "left_semi")
            else:
                rest = part if rest is None else rest & part
        return df if rest is None else df.where(value(rest, df)[0])

    def take(df: DataFrame, ordinals) -> DataFrame:
        if ordinals is None:
            return df
        cols = columns_of(df)
        return df.select(*[cols[i].alias(n) for i, n in zip(ordinals, unique_names(df.columns[i] for i in ordinals), strict=True)])

    def go(r: R.Relation) -> DataFrame:
        try:
            if r in memo:
                return memo[r]
        except TypeError:  # a literal that has no hash
            return node(r)
        memo[r] = node(r)
        return memo[r]

    def node(r: R.Relation) -> DataFrame:
        match r:
            case R.Read(table, columns, partial, subqueries):
                df = None
                if partial is not None and not subqueries and (prune := getattr(table_of, "pruned", None)):
                    df = prune(table, partial)
                df = table_of(table) if df is None else df
                if missing := [c for c in columns if c not in df.columns]:
                    raise KeyError(f"table {table} has no column {missing[0]}")
                if partial is not None:
                    df = filtered(df, partial, [go(s) for s in subqueries])
                return df.select(*[F.col(f"`{c}`") for c in columns])
            case R.Write(child, table):
                return table_of.write(table, go(child))
            case R.Project(child, exprs, names):
                df = go(child)
                names = names or tuple(_name(e, df) for e in exprs)
                if len(names) != len(exprs):
                    raise ValueError("a project needs a name for each expression")
                return df.select(*[value(e, df)[0].alias(n) for e, n in zip(exprs, unique_names(names), strict=True)])
            case R.Filter(child, condition, projection, subqueries):
                return take(filtered(go(child), condition, [go(s) for s in subqueries]), projection)
            case R.Join():
                left, right, how = go(r.left), go(r.right), r.type
                n = len(left.columns)
                if how == "inner" and r.unique in ("right", "either") and r.projection is not None and all(i < n for i in r.projection):
                    how = "left_semi"  # each left row meets one right row at most, and none of its columns is wanted
                if r.left_filter is not None:
                    left = left.where(value(r.left_filter, left)[0])
                if r.right_filter is not None:
                    right = right.where(value(r.right_filter, right)[0])
                return take(join_frames(left, right, r.condition, how, r.hint), r.projection)
            case R.Aggregate(child, keys, measures, mask):
                df = go(child)
                row = None
                if any(kind in PLACES for kind, _ in measures):
                    # the child's own row id if it appends one, else a new one; before the mask, so that ids are those of the input
                    if isinstance(child, R.RowId):
                        row = columns_of(df)[-1]
                    else:
                        df = df.select(*columns_of(df), F.monotonically_increasing_id().alias("_lodeframe_row"))
                        row = df["_lodeframe_row"]
                if mask is not None:
                    df = df.where(value(mask, df)[0])
                ks = [value(k, df)[0].alias(n) for k, n in zip(keys, unique_names(_name(k, df) for k in keys), strict=True)]
                names = unique_names([*(_name(k, df) for k in keys), *(f"{kind}_{i}" for i, (kind, _) in enumerate(measures))])[len(keys) :]
                ms = [aggregate_column(kind, None if e is None else value(e, df), row).alias(n) for (kind, e), n in zip(measures, names, strict=True)]
                if not ms:
                    return df.select(*ks).distinct()
                return df.groupBy(*ks).agg(*ms) if ks else df.agg(*ms)
            case R.Window():
                df = go(r.input)
                name = unique_names([*df.columns, r.function])[-1]
                over = window_column(r, lambda e: value(e, df))
                return df.select(*columns_of(df), over.alias(name))
            case R.Sort(child, keys):
                df = go(child)
                return df.orderBy(*[_order(value(e, df)[0], up, first) for e, up, first in keys])
            case R.Fetch(child, offset, count):
                if offset < 0 or count is not None and count < 0 or max(offset, count or 0) > (1 << 31) - 1:
                    raise ValueError("offset and count must be from 0 to 2147483647")
                df = go(child)
                df = df.offset(offset) if offset else df
                return df if count is None else df.limit(count)
            case R.SetOp(kind, left, right):
                a, b = go(left), go(right)
                if types_of(a) != types_of(b):
                    raise TypeError("both sides of a set operation need the same types")
                return getattr(a, {"union_all": "union", "union": "union", "intersect": "intersect", "minus": "subtract", "intersect_all": "intersectAll", "minus_all": "exceptAll"}[kind])(b) if kind != "union" else a.union(b).distinct()
            case R.Shuffle(child, columns, partitions):
                df = go(child)
                cols = [columns_of(df)[i] for i in columns]
                return df.repartition(partitions, *cols) if partitions else df.repartition(*cols)
            case R.RowId(child):
                df = go(child)
                return df.withColumn(unique_names([*df.columns, "row_id"])[-1], F.monotonically_increasing_id())
            case R.UserDefined(kids, function, names):
                df = function(*[go(k) for k in kids])
                return df.toDF(*names) if names else df
        raise TypeError(f"unknown relation {type(r).__name__}")

    return go(plan)


def conjuncts(e: E.Expr) -> list[E.Expr]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, E.Binary) and e.op == "and" else [e]


def _order(c, ascending: bool, nulls_first: bool):
    return (c.asc_nulls_first() if nulls_first else c.asc_nulls_last()) if ascending else (c.desc_nulls_first() if nulls_first else c.desc_nulls_last())


def _name(e: E.Expr, df: DataFrame) -> str:
    return df.columns[e.index] if isinstance(e, E.Ref) else str(e)

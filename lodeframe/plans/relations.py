"""Logical relations: plain values that compare, print and serialise. Columns are ordinals of the inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from lodeframe.functions import expressions as E

JOIN_TYPES = ("inner", "left", "left_semi", "left_anti", "full", "single", "cross")
AGGREGATES = ("sum", "avg", "min", "max", "count_all", "count_valid", "stddev", "variance", "median", "product", "sum_of_squares", "any", "all", "argmin", "argmax", "m2", "sum_with_overflow", "count_distinct", "approx_count_distinct")
WINDOWS = ("rank", "dense_rank", "row_number", "percent_rank", "cume_dist", "ntile", "lag", "lead", "sum", "avg", "min", "max", "count_all", "count_valid", "stddev", "variance")
SETS = ("union_all", "union", "intersect", "minus", "intersect_all", "minus_all")


@dataclass(frozen=True)
class Relation:
    def inputs(self) -> tuple:
        return tuple(x for f in fields(self) for x in (getattr(self, f.name) if f.name == "children" else (getattr(self, f.name),)) if isinstance(x, Relation) and f.name in ("input", "left", "right", "children"))


@dataclass(frozen=True)
class Read(Relation):
    """A table by name; ``columns`` by name; ``partial_filter`` counts columns of the whole table."""

    table: str
    columns: tuple
    partial_filter: E.Expr | None = None
    subqueries: tuple = ()


@dataclass(frozen=True)
class Write(Relation):
    input: Relation
    table: str


@dataclass(frozen=True)
class Project(Relation):
    input: Relation
    exprs: tuple
    names: tuple = ()


@dataclass(frozen=True)
class Filter(Relation):
    """Rows where ``condition`` is true; then only the columns ``projection`` (None: all)."""

    input: Relation
    condition: E.Expr
    projection: tuple | None = None
    subqueries: tuple = ()


@dataclass(frozen=True)
class Join(Relation):
    """The condition counts the left columns first, then the right ones. ``hint``: broadcast_left,
    broadcast_right or shuffle. ``unique``: none, left, right or either, set by a rule. ``left_filter`` and
    ``right_filter``: what rows of a side take part at all, by the side's own columns."""

    left: Relation
    right: Relation
    condition: E.Expr
    type: str = "inner"
    projection: tuple | None = None
    hint: str | None = None
    unique: str = "none"
    left_filter: E.Expr | None = None
    right_filter: E.Expr | None = None


@dataclass(frozen=True)
class Aggregate(Relation):
    """Output: the keys, then the measures (kind, expression or None). ``mask`` limits rows of all measures."""

    input: Relation
    keys: tuple
    measures: tuple
    mask: E.Expr | None = None


@dataclass(frozen=True)
class Window(Relation):
    """Appends one column. Bounds: None (unbounded) or a signed offset; ``unit``: range or rows."""

    input: Relation
    function: str
    arguments: tuple = ()
    order_by: tuple = ()
    partition_by: tuple = ()
    lower: int | None = None
    upper: int | None = 0
    unit: str = "range"


@dataclass(frozen=True)
class Sort(Relation):
    """``keys``: (expression, ascending, nulls_first)."""

    input: Relation
    keys: tuple


@dataclass(frozen=True)
class Fetch(Relation):
    input: Relation
    offset: int = 0
    count: int | None = None


@dataclass(frozen=True)
class SetOp(Relation):
    kind: str
    left: Relation
    right: Relation


@dataclass(frozen=True)
class Shuffle(Relation):
    """Hash-repartition by columns."""

    input: Relation
    columns: tuple
    partitions: int | None = None


@dataclass(frozen=True)
class RowId(Relation):
    """Appends a unique 64-bit row id."""

    input: Relation


@dataclass(frozen=True)
class UserDefined(Relation):
    """Tables to a table by a function of DataFrames; opaque to the rules, and not serialisable."""

    children: tuple
    function: Callable = field(compare=True)
    names: tuple = ()


NODES = {c.__name__: c for c in (Read, Write, Project, Filter, Join, Aggregate, Window, Sort, Fetch, SetOp, Shuffle, RowId)}
_EXPRS = {c.__name__: c for c in (E.Ref, E.Lit, E.Binary, E.Not, E.IsNull, E.Cast, E.Case, E.Like, E.Substring, E.DatePart, E.Round, E.InSubquery)}


def with_inputs(r: Relation, new) -> Relation:
    """``r`` with each input replaced by ``new(input)``."""
    if isinstance(r, UserDefined):
        return UserDefined(tuple(map(new, r.children)), r.function, r.names)
    return type(r)(**{f.name: new(v) if isinstance(v := getattr(r, f.name), Relation) else v for f in fields(r)})


def to_string(r: Relation, depth: int = 0) -> str:
    """An indented plan, one relation a line."""

    def show(v):
        return "[" + ", ".join(map(show, v)) + "]" if isinstance(v, tuple) else str(v)

    own = ", ".join(f"{f.name}={show(getattr(r, f.name))}" for f in fields(r) if f.name not in ("input", "left", "right", "children", "function", "subqueries") or isinstance(r, Window) and f.name == "function")
    return "\n".join(["  " * depth + f"{type(r).__name__}({own})", *(to_string(x, depth + 1) for x in r.inputs())])


def to_dict(x: Any) -> Any:
    """JSON-ready form of a plan; a user-defined relation has none."""
    if isinstance(x, UserDefined):
        raise ValueError("a user-defined relation cannot be serialised")
    if is_dataclass(x):
        return {"kind": type(x).__name__} | {f.name: to_dict(getattr(x, f.name)) for f in fields(x)}
    if isinstance(x, tuple | list):
        return [to_dict(v) for v in x]
    return {"kind": "date", "value": x.isoformat()} if hasattr(x, "isoformat") else x


def from_dict(x: Any) -> Any:
    import datetime

    if isinstance(x, list):
        return tuple(map(from_dict, x))
    if isinstance(x, dict):
        kind = x["kind"]
        if kind == "date":
            return datetime.date.fromisoformat(x["value"])
        made = NODES.get(kind) or _EXPRS.get(kind)
        if made is None:
            raise ValueError(f"unknown relation {kind!r}")
        return made(**{k: from_dict(v) for k, v in x.items() if k != "kind"})
    return x

"""Typed expressions: plain values that compare and print, and compile to Spark columns by ordinal.

``compile(expr, columns, types)`` gives (Column, DataType). The engine's own typing rules are applied
here, by casts; everything else is left to Catalyst.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.types import SPARK, arithmetic_type, is_numeric, spark_type


@dataclass(frozen=True)
class Expr:
    def __add__(self, o):
        return Binary("+", self, wrap(o))

    def __sub__(self, o):
        return Binary("-", self, wrap(o))

    def __mul__(self, o):
        return Binary("*", self, wrap(o))

    def __truediv__(self, o):
        return Binary("/", self, wrap(o))

    def __lt__(self, o):
        return Binary("<", self, wrap(o))

    def __le__(self, o):
        return Binary("<=", self, wrap(o))

    def __gt__(self, o):
        return Binary(">", self, wrap(o))

    def __ge__(self, o):
        return Binary(">=", self, wrap(o))

    def __and__(self, o):
        return Binary("and", self, wrap(o))

    def __or__(self, o):
        return Binary("or", self, wrap(o))

    def __invert__(self):
        return Not(self)

    def eq(self, o):
        return Binary("=", self, wrap(o))

    def ne(self, o):
        return Binary("<>", self, wrap(o))

    def same(self, o):
        """IS NOT DISTINCT FROM."""
        return Binary("<=>", self, wrap(o))


@dataclass(frozen=True)
class Ref(Expr):
    """A column by ordinal; the name, if any, is for people and does not count in comparisons."""

    index: int
    name: str | None = field(default=None, compare=False)

    def __str__(self):
        return f"${self.index}" if self.name is None else self.name


@dataclass(frozen=True)
class Lit(Expr):
    value: Any
    type: str | None = None

    def __str__(self):
        return "NULL" if self.value is None else repr(self.value)


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self):
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Not(Expr):
    child: Expr

    def __str__(self):
        return f"NOT {self.child}"


@dataclass(frozen=True)
class IsNull(Expr):
    child: Expr

    def __str__(self):
        return f"({self.child} IS NULL)"


@dataclass(frozen=True)
class Cast(Expr):
    child: Expr
    type: str

    def __str__(self):
        return f"CAST({self.child} AS {self.type})"


@dataclass(frozen=True)
class Case(Expr):
    """``branches``: (condition, value) in order. A null condition goes on to the next."""

    branches: tuple
    otherwise: Expr | None = None

    def __str__(self):
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in self.branches) + f" ELSE {self.otherwise} END"


@dataclass(frozen=True)
class Like(Expr):
    child: Expr
    pattern: str
    escape: str = "\\"
    ignore_case: bool = False

    def __str__(self):
        return f"({self.child} {'I' * self.ignore_case}LIKE {self.pattern!r})"


@dataclass(frozen=True)
class Substring(Expr):
    child: Expr
    start: int
    length: int

    def __str__(self):
        return f"substring({self.child}, {self.start}, {self.length})"


@dataclass(frozen=True)
class DatePart(Expr):
    part: str
    child: Expr

    def __str__(self):
        return f"date_part({self.part}, {self.child})"


@dataclass(frozen=True)
class Round(Expr):
    child: Expr
    digits: int = 0

    def __str__(self):
        return f"round({self.child}, {self.digits})"


@dataclass(frozen=True)
class InSubquery(Expr):
    """``needle IN (relation number ``relation`` of the node's subqueries)``, its first column."""

    needle: Expr
    relation: int

    def __str__(self):
        return f"({self.needle} IN #{self.relation})"


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def col(index: int, name: str | None = None) -> Ref:
    return Ref(index, name)


def in_list(needle: Expr, values) -> Expr:
    """An IN list is an OR of equalities; an empty one is false."""
    out: Expr | None = None
    for v in values:
        one = needle.eq(v)
        out = one if out is None else out | one
    return Lit(False) if out is None else out


def between(x: Expr, low, high) -> Expr:
    return (x >= low) & (x <= high)


def children(e: Expr) -> tuple:
    match e:
        case Binary(_, a, b):
            return (a, b)
        case Not(c) | IsNull(c) | Cast(c, _) | Like(c, _, _, _) | Substring(c, _, _) | DatePart(_, c) | Round(c, _) | InSubquery(c, _):
            return (c,)
        case Case(branches, otherwise):
            return (*(x for b in branches for x in b), *((otherwise,) if otherwise is not None else ()))
    return ()


def rebuild(e: Expr, f) -> Expr:
    """``e`` with ``f`` applied to each child."""
    match e:
        case Binary(op, a, b):
            return Binary(op, f(a), f(b))
        case Not(c):
            return Not(f(c))
        case IsNull(c):
            return IsNull(f(c))
        case Cast(c, t):
            return Cast(f(c), t)
        case Like(c, p, x, i):
            return Like(f(c), p, x, i)
        case Substring(c, s, n):
            return Substring(f(c), s, n)
        case DatePart(p, c):
            return DatePart(p, f(c))
        case Round(c, d):
            return Round(f(c), d)
        case InSubquery(c, r):
            return InSubquery(f(c), r)
        case Case(branches, otherwise):
            return Case(tuple((f(c), f(v)) for c, v in branches), None if otherwise is None else f(otherwise))
    return e


def refs(e: Expr) -> set[int]:
    return {e.index} if isinstance(e, Ref) else set().union(*map(refs, children(e)))


def remap(e: Expr, to: dict[int, int]) -> Expr:
    return Ref(to[e.index], e.name) if isinstance(e, Ref) else rebuild(e, lambda c: remap(c, to))


def replace_refs(e: Expr, values: list[Expr]) -> Expr:
    return values[e.index] if isinstance(e, Ref) else rebuild(e, lambda c: replace_refs(c, values))


_LITERALS = ((bool, "bool"), (int, "i32"), (float, "f64"), (str, "string"), (datetime.date, "date"))
_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<=>": lambda a, b: a.eqNullSafe(b)}
#: Component -> how it is taken from a date or timestamp; Monday is weekday 1.
_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": lambda c: F.weekday(c) + 1, "hour": F.hour, "minute": F.minute, "second": F.second,
    "millisecond": lambda c: F.date_format(c, "SSS").cast("int"), "microsecond": lambda c: F.substring(F.date_format(c, "SSSSSS"), 4, 3).cast("int"), "nanosecond": lambda c: F.lit(0),
}


def true_division(a: Column, b: Column) -> Column:
    """IEEE division of doubles: by zero it gives infinities or NaN, and never raises."""
    signed_zero = F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * signed_zero * F.lit(float("inf")))
    return F.when(b == 0, F.when(a.isNotNull(), by_zero)).otherwise(a / F.when(b != 0, b))


def compile(e: Expr, columns: list[Column], types: list[T.DataType], subqueries=()) -> tuple[Column, T.DataType]:
    def go(x):
        return compile(x, columns, types, subqueries)

    match e:
        case Ref(i, _):
            if not 0 <= i < len(columns):
                raise IndexError(f"column {i} of {len(columns)}")
            return columns[i], types[i]
        case Lit(v, t):
            if t is None:
                if v is None:
                    raise TypeError("a NULL literal needs a type")
                t = next((n for k, n in _LITERALS if isinstance(v, k)), None)
                if t is None:
                    raise TypeError(f"no literal of {type(v).__name__}")
                if t == "i32" and not -(1 << 31) <= v < 1 << 31:
                    t = "i64"
            kind = SPARK.get(t) or spark_type(t)
            return F.lit(v).cast(kind), kind
        case Binary("+" | "-" | "*" as op, a, b):
            (x, xt), (y, yt) = go(a), go(b)
            kind = arithmetic_type(xt, yt)
            x, y = x.cast(kind), y.cast(kind)
            return (x + y if op == "+" else x - y if op == "-" else x * y), kind
        case Binary("/", a, b):
            (x, xt), (y, yt) = go(a), go(b)
            arithmetic_type(xt, yt)
            return true_division(x.cast("double"), y.cast("double")), T.DoubleType()
        case Binary("and" | "or" as op, a, b):
            x, y = go(a)[0], go(b)[0]
            return (x & y if op == "and" else x | y), T.BooleanType()
        case Binary(op, a, b) if op in _COMPARE:
            (x, xt), (y, yt) = go(a), go(b)
            if is_numeric(xt) != is_numeric(yt) and not {type(xt), type(yt)} & {T.NullType}:
                raise TypeError(f"cannot compare {xt.simpleString()} with {yt.simpleString()}")
            return _COMPARE[op](x, y), T.BooleanType()
        case Not(c):
            return ~go(c)[0], T.BooleanType()
        case IsNull(c):
            return go(c)[0].isNull(), T.BooleanType()
        case Cast(c, t):
            kind = spark_type(t)
            return go(c)[0].cast(kind), kind
        case Case(branches, otherwise):
            out, kind = None, None
            for c, v in branches:
                x, xt = go(v)
                if kind is not None and xt != kind:
                    raise TypeError("the branches of CASE differ in type")
                kind = xt
                out = F.when(go(c)[0], x) if out is None else out.when(go(c)[0], x)
            if otherwise is not None:
                x, xt = go(otherwise)
                if xt != kind:
                    raise TypeError("the branches of CASE differ in type")
                out = out.otherwise(x)
            return out, kind
        case Like(c, pattern, escape, ignore_case):
            x = go(c)[0]
            i, lone = 0, False
            while i < len(pattern):
                if pattern[i] == escape:
                    lone = i + 1 == len(pattern)
                    i += 1
                i += 1
            if lone:  # a pattern that ends in a lone escape matches nothing
                return F.when(x.isNotNull(), F.lit(False)), T.BooleanType()
            out, i = "", 0
            while i < len(pattern):  # Spark wants only %, _ and the escape itself escaped
                if pattern[i] == escape:
                    i += 1
                    out += ("\\" + pattern[i]) if pattern[i] in "%_\\" else pattern[i]
                else:
                    out += "\\\\" if pattern[i] == "\\" else pattern[i]
                i += 1
            return (F.ilike if ignore_case else F.like)(x, F.lit(out)), T.BooleanType()
        case Substring(c, start, length):
            if start < 1:
                raise ValueError("substring starts at 1")
            return F.substring(go(c)[0], start, length), T.StringType()
        case DatePart(part, c):
            if part.lower() not in _PARTS:
                raise ValueError(f"date_part has no component {part!r}")
            return _PARTS[part.lower()](go(c)[0]).cast("smallint"), T.ShortType()
        case Round(c, digits):
            x, xt = go(c)
            return F.round(x, digits).cast(xt), xt
        case InSubquery():
            raise ValueError("IN (subquery) stands only in filters and partial filters")
    raise TypeError(f"unknown expression {e!r}")

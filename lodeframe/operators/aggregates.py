"""Aggregate functions by the engine's names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions.types import INTEGRAL


#: Aggregates that give the id of a row.
PLACES = ("argmin", "argmax")


def aggregate_column(kind: str, arg: tuple[Column, T.DataType] | None, row: Column | None = None) -> Column:
    """``arg`` is (column, type), or None for count_all. Null inputs are passed over by all but count_all. ``row``:
    the row id that argmin and argmax give; of equal values the smallest id, null if all are null."""
    if kind == "count_all":
        return F.count(F.lit(1))
    if arg is None:
        raise ValueError(f"{kind} needs an argument")
    c, t = arg
    whole = isinstance(t, INTEGRAL)
    match kind:
        case "sum":
            return F.sum(c.cast("bigint") if whole else c)
        case "avg":
            return F.avg(c.cast("double"))
        case "min":
            return F.min(c)
        case "max":
            return F.max(c)
        case "count_valid":
            return F.count(c)
        case "stddev":
            return F.stddev_samp(c.cast("double"))
        case "variance":
            return F.var_samp(c.cast("double"))
        case "median":
            return F.median(c.cast("double"))
        case "product":
            return F.product(c.cast("double")).cast("bigint" if whole else "double")
        case "sum_of_squares":
            wide = c.cast("bigint" if whole else "double")
            return F.sum(wide * wide)
        case "any":
            return F.bool_or(c.cast("boolean"))
        case "all":
            return F.bool_and(c.cast("boolean"))
        case "argmin" | "argmax":
            if row is None:
                raise ValueError(f"{kind} needs a row id")
            if kind == "argmin":
                return F.min(F.when(c.isNotNull(), F.struct(c.alias("v"), row.alias("row"))))["row"]
            return -F.max(F.when(c.isNotNull(), F.struct(c.alias("v"), (-row).alias("row"))))["row"]
        case "m2":
            return F.var_pop(c.cast("double")) * F.count(c)
        case "sum_with_overflow":
            return F.try_sum(c.cast("bigint") if whole else c)
        case "count_distinct":
            return F.count_distinct(c)
        case "approx_count_distinct":
            return F.approx_count_distinct(c)
    raise ValueError(f"unknown aggregate {kind!r}")

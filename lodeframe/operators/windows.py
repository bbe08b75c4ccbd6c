"""Window functions over RANGE and ROWS frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeframe.functions import expressions as E
from lodeframe.functions.types import INTEGRAL
from lodeframe.operators.aggregates import aggregate_column

_RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def window_column(r, value) -> Column:
    """The column of a Window relation; ``value(expr)`` gives (Column, type).

    Partitions by null keys are partitions like any other. Ranking functions take no frame. A bounded
    RANGE frame needs one integral order column. ROWS frames are taken as written.
    """
    order = []
    for e, up, first in r.order_by:
        c = value(e)[0]
        order.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()))
    w = W.partitionBy(*[value(e)[0] for e in r.partition_by])
    if order:
        w = w.orderBy(*order)
    if r.function in _RANKS or r.function == "ntile" or r.function in ("lag", "lead"):
        if not order:
            raise ValueError(f"{r.function} needs an order")
        if r.function in _RANKS:
            return _RANKS[r.function]().over(w)
        n = next((a.value for a in reversed(r.arguments) if isinstance(a, E.Lit)), 1)
        return (F.ntile(n) if r.function == "ntile" else getattr(F, r.function)(value(r.arguments[0])[0], n)).over(w)
    arg = value(r.arguments[0]) if r.arguments else None
    f = aggregate_column(r.function, arg)
    if not order:
        return f.over(w)
    low = W.unboundedPreceding if r.lower is None else r.lower
    high = W.unboundedFollowing if r.upper is None else r.upper
    if r.unit == "rows":
        return f.over(w.rowsBetween(low, high))
    if {r.lower, r.upper} - {None, 0} and (len(order) != 1 or not isinstance(value(r.order_by[0][0])[1], INTEGRAL)):
        raise ValueError("a bounded RANGE frame needs one integral order column")
    return f.over(w.rangeBetween(low, high))

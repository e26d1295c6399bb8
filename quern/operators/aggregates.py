"""Aggregates over distinct head tuples. A group without tuples gives no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PRIMITIVE, WIDE, wrap
from ..plans.types import BITS, Type


def _total(c: Column, p: str) -> Column:
    """A sum that wraps in its width."""
    if p not in BITS:
        return F.sum(c.cast("double")).cast(PRIMITIVE[p])
    if BITS[p] == 64:
        return wrap(F.sum(c.cast(WIDE)).cast(WIDE), p)
    return wrap(F.sum(c.cast("long")), p)


def expression(op: str, c: Column, t: Type) -> Column:
    p = t.prim
    if op == "count":
        n = F.count(F.lit(1))
        return wrap(n.cast(WIDE) if BITS[p] == 64 else n, p) if p in BITS else n.cast(PRIMITIVE[p])
    if op == "sum":
        return _total(c, p)
    if op == "average":
        if p not in BITS:
            return (F.sum(c.cast("double")) / F.count(F.lit(1))).cast(PRIMITIVE[p])
        # integers truncate, the total in the width of the column
        total = _total(c, p)
        return F.call_function("div", total if p == "uint64" else total.cast("long"), F.count(F.lit(1))).cast(PRIMITIVE[p])
    return {"min": F.min, "max": F.max}[op](c)


def aggregate(distinct: DataFrame, op: str, at: int, types: tuple) -> DataFrame:
    names = [f"c{i}" for i in range(len(types))]
    keys = [n for i, n in enumerate(names) if i != at]
    value = expression(op, F.col(f"c{at}"), types[at]).alias(f"c{at}")
    if keys:
        return distinct.groupBy(*keys).agg(value).select(*names)
    return distinct.groupBy().agg(value, F.count(F.lit(1)).alias("n")).where("n > 0").select(*names)

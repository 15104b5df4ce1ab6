"""Ordered computations along a key that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a key into one task. Here the rows of a key are cut into chunks by the span of
their first order column; windows run within (key, chunk), and one row a chunk carries what passes over its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Samples a chunk spans by default: 1,000 seconds. Rows of a recording are no denser than speech, so a chunk holds at most some thousands, however many the recording has.
SPAN = 16_000_000


def along(
    df: DataFrame, key: str, order: list[str], span: float = SPAN, *, prev: dict[str, Column] | None = None, next: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None, top: dict[str, Column] | None = None, top_before: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` with columns computed along ``order`` within ``key``.

    prev, next: the value of the neighbour row (NULL at the ends); total: the running sum, top: the running maximum,
    both including the row; top_before: the running maximum of the rows before; last: the latest value that is not NULL of the rows
    before. ``order`` must be unique within a key for a defined result; its first column is numeric and gives the chunk. Rows
    with a NULL key or first order column belong to no order and are dropped. Names given must not be among the columns of ``df``.
    The join of the carried rows is on (key, chunk), by which the windows have already partitioned the rows.
    """
    prev, next, total, top, top_before, last = (x or {} for x in (prev, next, total, top, top_before, last))
    columns = df.columns
    df = df.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    df = df.withColumn("__c", F.floor(F.col(order[0]) / F.lit(span)).cast("long"))
    inner = Window.partitionBy(key, "__c").orderBy(*order)
    so_far, before = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    # The values themselves, so that expressions are evaluated once; a struct keeps NULL values apart from missing rows.
    taken = {**prev, **next, **total, **top, **top_before, **last}
    df = df.withColumns({f"__v_{k}": v for k, v in taken.items()})
    v = lambda k: F.col(f"__v_{k}")
    within: dict[str, Column] = {}
    for k in prev:
        within[f"__i_{k}"] = F.lag(F.struct(v(k).alias("v"))).over(inner)
    for k in next:
        within[f"__i_{k}"] = F.lead(F.struct(v(k).alias("v"))).over(inner)
    for k in total:
        within[f"__i_{k}"] = F.sum(v(k)).over(so_far)
    for k in top:
        within[f"__i_{k}"] = F.max(v(k)).over(so_far)
    for k in top_before:
        within[f"__i_{k}"] = F.max(v(k)).over(before)
    for k in last:
        within[f"__i_{k}"] = F.last(v(k), True).over(before)
    df = df.withColumns(within)

    edges: list[Column] = []
    for k in prev:
        edges.append(F.max_by(F.struct(v(k).alias("v")), place).alias(f"__e_{k}"))
    for k in next:
        edges.append(F.min_by(F.struct(v(k).alias("v")), place).alias(f"__e_{k}"))
    for k in total:
        edges.append(F.sum(v(k)).alias(f"__e_{k}"))
    for k in (*top, *top_before):
        edges.append(F.max(v(k)).alias(f"__e_{k}"))
    for k in last:
        edges.append(F.max_by(v(k), F.when(v(k).isNotNull(), place)).alias(f"__e_{k}"))
    outer = Window.partitionBy(key).orderBy("__c")
    past = outer.rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(key, "__c").agg(*edges)
    carried: dict[str, Column] = {}
    e = lambda k: F.col(f"__e_{k}")
    for k in prev:
        carried[f"__o_{k}"] = F.lag(e(k)).over(outer)
    for k in next:
        carried[f"__o_{k}"] = F.lead(e(k)).over(outer)
    for k in total:
        carried[f"__o_{k}"] = F.sum(e(k)).over(past)
    for k in (*top, *top_before):
        carried[f"__o_{k}"] = F.max(e(k)).over(past)
    for k in last:
        carried[f"__o_{k}"] = F.last(e(k), True).over(past)
    chunks = chunks.withColumns(carried).select(key, "__c", *carried)
    out = df.join(chunks, [key, "__c"])
    i, o = (lambda k: F.col(f"__i_{k}")), (lambda k: F.col(f"__o_{k}"))
    made: dict[str, Column] = {}
    for k in (*prev, *next):
        made[k] = F.coalesce(i(k), o(k))["v"]
    for k in total:
        made[k] = F.when(i(k).isNotNull() | o(k).isNotNull(), F.coalesce(i(k), F.lit(0)) + F.coalesce(o(k), F.lit(0)))
    for k in (*top, *top_before):
        made[k] = F.greatest(i(k), o(k))
    for k in last:
        made[k] = F.coalesce(i(k), o(k))
    return out.withColumns(made).select(*columns, *made)

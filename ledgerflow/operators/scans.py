"""Scans over the rows of a statement in order, in two levels, so that a statement of any length is shared by many tasks.

Rows are cut into ranges of ``span`` places of their order column. A range is one window partition; what it takes from the ranges before
or after it (a last value, a running sum) is its carry. Carries come from one aggregated row per range, scanned in turn, and are kept
for statements of several ranges only: usual statements have one range, so the carries' table is small and joins without moving rows.

The input is read twice: once for the carries, of the columns they need. Rows of equal order fall into one range; rows without an order
come first, as in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Places of the order column in a range.
SPAN = 1 << 17
PART = "_part"


def in_ranges(df: DataFrame, span: int = SPAN, order: str = "row_seq") -> DataFrame:
    """``df`` with the number of each row's range."""
    return df.withColumn(PART, F.coalesce(F.floor(F.col(order).cast("decimal(20,0)") / F.lit(span)).cast("long"), F.lit(-(1 << 62))))


def place(order: str = "row_seq") -> Column:
    return F.coalesce(F.col(order), F.lit(-(1 << 62)))


def of_range(key: Sequence[str], order: str = "row_seq") -> WindowSpec:
    return Window.partitionBy(*key, PART).orderBy(order)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def up_to(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def carry(rows: DataFrame, key: Sequence[str], aggregates: dict[str, Column], carries: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``rows`` with the columns of ``carries``: expressions over ``aggregates`` of all ranges of a statement, in the window given.
    Null where a statement has one range."""
    each = rows.groupBy(*key, PART).agg(*(c.alias(name) for name, c in aggregates.items()))
    w = Window.partitionBy(*key).orderBy(PART)
    out = each
    for name, c in carries(w).items():
        out = out.withColumn(name, c)
    names = list(carries(w))
    out = out.withColumn("_ranges", F.count("*").over(Window.partitionBy(*key))).where("_ranges > 1")
    out = out.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key)), F.col(PART).alias("_of"), *names)
    same = F.col(PART) == F.col("_of")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(out, same, "left").drop("_of", *(f"_key{i}" for i in range(len(key))))


def scan(df: DataFrame, key: Sequence[str], span: int = SPAN, order: str = "row_seq", **what: tuple[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``what``, a kind and a value:

    ``lag``: the value of the row before. ``last``: the last value before the row that is not null. ``next``: the first after it.
    ``sum``: the sum up to the row, itself included (null while all values are null).
    """
    values = {f"_v_{name}": v for name, (_, v) in what.items()}
    rows = in_ranges(df.withColumns(values), span, order)
    aggregates, w = {}, of_range(key, order)
    for name, (kind, _) in what.items():
        v, at = F.col(f"_v_{name}"), place(order)
        shown = F.when(v.isNotNull(), at)
        aggregates[f"_a_{name}"] = {"lag": F.max_by(v, at), "last": F.max_by(v, shown), "next": F.min_by(v, shown), "sum": F.sum(v)}[kind]

    def carries(ranges: WindowSpec) -> dict[str, Column]:
        out = {}
        for name, (kind, _) in what.items():
            a = F.col(f"_a_{name}")
            out[f"_c_{name}"] = {"lag": lambda a: F.lag(a).over(ranges), "last": lambda a: F.last(a, True).over(before(ranges)), "next": lambda a: F.first(a, True).over(after(ranges)), "sum": lambda a: F.sum(a).over(before(ranges))}[kind](a)
        return out

    rows = carry(rows, key, aggregates, carries)
    added = {}
    for name, (kind, _) in what.items():
        v, c = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if kind == "lag":
            added[name] = F.when(F.lag(F.lit(True)).over(w), F.lag(v).over(w)).otherwise(c)
        elif kind == "sum":
            own = F.sum(v).over(up_to(w))
            added[name] = F.coalesce(own + c, own, c)
        else:
            own = F.last(v, True).over(before(w)) if kind == "last" else F.first(v, True).over(after(w))
            added[name] = F.coalesce(own, c)
    return rows.withColumns(added).drop(*values, *(f"_c_{name}" for name in what))

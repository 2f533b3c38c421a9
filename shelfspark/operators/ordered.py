"""Numbers, fills and running sums in an order inside a group, for groups of any size.

A window over one group sorts that group in one task. Here rows are first dealt into ranges of (keys, order), so a large group lies in many
ranges; each range is worked on by itself, and what its predecessors of the same group hand over (rows so far, last values, sums) is one
row for each range that begins inside a group: fewer rows than ranges, so that table is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

POSITION, RANGE = "__position", "__range"


@dataclass(frozen=True)
class Number:
    """The row's number in its group, from 1."""


@dataclass(frozen=True)
class Fill:
    """The last non-null value so far, or of the rows before."""

    column: str
    before: bool = False


@dataclass(frozen=True)
class Total:
    """The sum so far; nulls count as nothing."""

    column: str


def ranges(rows: DataFrame, keys: list[str], order: list[Column | str], n: int | None = None) -> DataFrame:
    """rows in n ranges of (keys, order) with their place in it, written once so that places stay the same. Rows that are equal in all of
    these share a range: give order a last column that tells rows apart."""
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn(POSITION, F.monotonically_increasing_id())
    return durable(placed.withColumn(RANGE, F.shiftright(POSITION, 33)), "ranges")


def in_order(rows: DataFrame, keys: list[str], order: list[Column | str], asks: dict[str, Number | Fill | Total], n: int | None = None) -> DataFrame:
    """rows with a column for each of asks, each taken inside a group of equal keys (nulls are one group) in the given order."""
    placed = rows if POSITION in rows.columns else ranges(rows, keys, order, n)
    here = Window.partitionBy(RANGE, *keys).orderBy(POSITION)
    so_far, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)

    sums, parts, carries, whole = {}, {}, {}, {}
    groups = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, ask) in enumerate(asks.items()):
        part, carry = f"__part{i}", f"__carry{i}"
        if isinstance(ask, Number):
            sums[part], parts[part], carries[carry] = F.count("*"), F.row_number().over(here), F.sum(part).over(groups)
            whole[name] = F.col(part) + F.coalesce(carry, F.lit(0))
        elif isinstance(ask, Total):
            sums[part], parts[part], carries[carry] = F.sum(ask.column), F.sum(ask.column).over(so_far), F.sum(part).over(groups)
            whole[name] = F.coalesce(part, F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            value = F.when(F.col(ask.column).isNotNull(), F.struct(F.col(ask.column).alias("v")))
            sums[part] = F.max_by(value, F.when(value.isNotNull(), F.col(POSITION)))
            parts[part] = F.last(ask.column, ignorenulls=True).over(before if ask.before else so_far)
            carries[carry] = F.last(F.col(part)["v"], ignorenulls=True).over(groups)
            whole[name] = F.coalesce(part, carry)
    held = placed.groupBy(RANGE, *keys).agg(*[c.alias(p) for p, c in sums.items()])
    first = F.min(RANGE).over(Window.partitionBy(*keys))
    handed = held.withColumns(carries | {"__first": first}).where(F.col(RANGE) > F.col("__first")).select(F.col(RANGE).alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *carries)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col(RANGE) == F.col("__r"))
    # at most one group goes on from a range into the next one: fewer rows than ranges
    found = placed.withColumns(parts).join(F.broadcast(handed), same, "left")
    return found.select(*rows.columns, *[c.alias(name) for name, c in whole.items()], *([] if POSITION in rows.columns else [POSITION, RANGE]))


def plain(rows: DataFrame) -> DataFrame:
    """Without the places."""
    return rows.drop(POSITION, RANGE)

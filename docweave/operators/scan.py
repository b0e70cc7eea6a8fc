"""Scans: what runs on from row to row in an order, without a window or a group that holds a whole act or table.

Rows are dealt out by ranges of (keys, order) and stored, with the number of their range. Inside a range an ordinary window runs on. What
a range begins with comes from one row of each range and key; only a key that goes on from one range into the next has
something to carry, so there are fewer carries than ranges, and they are broadcast.

Defined results: null is a key like any other; rows of one key and order go on in any sequence, so orders should be unique in a key; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.storage import cut

PART, KEY = "__part", "__scan_key"


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with the numbers of their ranges, stored as they are dealt out (the ranges come from a sample)."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return cut(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()).withColumn(KEY, key))


def _inside(order: list[str]) -> Window:
    return Window.partitionBy(PART, KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before() -> Window:
    return Window.partitionBy(KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def _joined(rows: DataFrame, carries: DataFrame, names: list[str]) -> DataFrame:
    has = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(True)) for n in names], F.lit(False))
    few = carries.filter(has).select(PART, KEY, *[F.col(n).alias(f"__carry_{n}") for n in names])
    return rows.join(F.broadcast(few), [PART, KEY], "left")


def carried(rows: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """ranged() rows with, of each value, the last that is not null at or before the row among those of its key."""
    names = list(values)
    inside = rows.withColumns({n: F.last(v, ignorenulls=True).over(_inside(order)) for n, v in values.items()})
    ends = rows.groupBy(KEY, PART).agg(*[F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(n) for n, v in values.items()])
    carries = ends.select(KEY, PART, *[F.last(n, ignorenulls=True).over(_before()).alias(n) for n in names])
    return _joined(inside, carries, names).withColumns({n: F.coalesce(n, f"__carry_{n}") for n in names}).drop(*[f"__carry_{n}" for n in names])


def running(rows: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """ranged() rows with the running sum of each value (whole numbers), the row's own included."""
    names = list(values)
    inside = rows.withColumns({n: F.sum(v).over(_inside(order)) for n, v in values.items()})
    sums = rows.groupBy(KEY, PART).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    carries = sums.select(KEY, PART, *[F.sum(n).over(_before()).alias(n) for n in names])
    zero = F.lit(0).cast("long")
    return _joined(inside, carries, names).withColumns({n: F.coalesce(n, zero) + F.coalesce(f"__carry_{n}", zero) for n in names}).drop(*[f"__carry_{n}" for n in names])


def finished(rows: DataFrame) -> DataFrame:
    return rows.drop(PART, KEY)

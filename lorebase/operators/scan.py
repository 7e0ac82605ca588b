"""Segmented prefix scans: running sums and nearest values within keys of any size.

A window over a key puts all of its rows into one task. Here rows are dealt out by ranges of (key, order), so that a key
may span many tasks; each task scans its own rows, and what a task's fragment of a key hands on (a sum, its last or first
value) is combined over fragments. Of all keys only those that cross a range's end have more than one fragment, two for
each range at most: the table of carries has at most twice as many rows as there are ranges, however large the data is,
and may be sent to all tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


class Running(NamedTuple):
    """What is kept while scanning: kind is "sum" (of this and earlier rows), "previous" or "next" (the nearest value that
    isn't null, in this row or before or behind it)."""

    kind: str
    value: Column


def _reversed(order: list[Column]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def scan(df: DataFrame, by: list[str], order: list[str], running: dict[str, Running], ranges: int | None = None) -> DataFrame:
    """df with one more column for each of `running`. The order within a key must be total: rows that agree in all of
    by and order share a task. Null keys are one key; nulls come first.
    """
    spark = df.sparkSession
    names = {k: f"__v_{k}" for k in running}
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("*", *[r.value.alias(names[k]) for k, r in running.items()])
    # Written, as the same rows must be in the same range whenever they are read.
    rows = written(rows.repartitionByRange(ranges, *[F.col(c) for c in (*by, *order)]).withColumn("__range", F.spark_partition_id()), "scan")
    ahead = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("__range", *by).orderBy(*_reversed(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = {"sum": lambda c: F.sum(c).over(ahead), "previous": lambda c: F.last(c, ignorenulls=True).over(ahead), "next": lambda c: F.last(c, ignorenulls=True).over(back)}
    whole = {"sum": lambda c: F.sum(c), "previous": lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.struct(*order)))["v"], "next": lambda c: F.min_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.struct(*order)))["v"]}
    fragments = rows.groupBy("__range", *by).agg(*[whole[r.kind](names[k]).alias(names[k]) for k, r in running.items()])
    key = F.struct(F.lit(0), *by)
    fragments = fragments.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where("__n > 1") if by else fragments
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before, behind = over.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), over.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    handed = {"sum": lambda c: F.sum(c).over(before), "previous": lambda c: F.last(c, ignorenulls=True).over(before), "next": lambda c: F.last(c, ignorenulls=True).over(behind)}
    carries = fragments.select(F.col("__range").alias("__r"), key.alias("__held"), *[handed[r.kind](names[k]).alias(f"__c_{k}") for k, r in running.items()])
    rows = rows.select(*df.columns, "__range", key.alias("__key"), *[local[r.kind](names[k]).alias(names[k]) for k, r in running.items()])
    joined = rows.join(F.broadcast(carries), (F.col("__range") == F.col("__r")) & F.col("__key").eqNullSafe(F.col("__held")), "left")
    total = {"sum": lambda own, carry: F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)), "previous": F.coalesce, "next": F.coalesce}
    return joined.select(*df.columns, *[total[r.kind](F.col(names[k]), F.col(f"__c_{k}")).alias(k) for k, r in running.items()])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "k", ranges: int | None = None) -> DataFrame:
    """df with each row's number within its key, from 1."""
    return scan(df, by, order, {name: Running("sum", F.lit(1).cast("long"))}, ranges)

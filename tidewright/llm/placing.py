"""Places of rows in an order within groups of any size, and what lies before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def matched(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, in which null is equal to null."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in names})
    return a.join(b, reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_{c}"]) for c in names)), how).drop(*(f"_{c}" for c in names))


def placed(rows: DataFrame, group: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Adds ``pos``, the row's place in its group from 0, and ``n``, the group's rows; with ``value`` also
    ``before`` and ``total``, its sums over the rows before and over the group. Nulls come first.

    Rows are range-partitioned by group and order and written once; a part's rows are numbered by their
    place in it, and shifted by what earlier parts hold of the same group. So a group that is any part
    of the table is spread over tasks, and no task gathers more than a part. ``rows`` are evaluated twice
    (bounds and rows): pass a written table."""
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    keys = ["_part", *group]
    summed = [F.sum(value).alias("_sum")] if value else []
    runs = ranged.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *summed)
    earlier, whole = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)  # a row a part of the group
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    runs = runs.withColumn("_shift", before("_n") - F.col("_first")).withColumn("n", F.sum("_n").over(whole))
    if value:
        runs = runs.withColumn("_before", before("_sum")).withColumn("total", F.sum("_sum").over(whole))
        own = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    out = matched(ranged, runs, keys).withColumn("pos", F.col("_at") + F.col("_shift"))
    if value:
        out = out.withColumn("before", F.col("_own") + F.col("_before"))
    return out.drop("_at", "_part", "_first", "_n", "_sum", "_shift", "_before", "_own")

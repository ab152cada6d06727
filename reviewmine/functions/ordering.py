"""Positions in a total order and within keys, and dense ids, without a one-task window.

``ranked`` range-partitions the rows, so every task holds one slice of the
order; a slice knows its own positions and only the per-slice row counts (one
row per partition) are summed up to place the slices after each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmine.sources.shared import attach, materialize


def _slices(df: DataFrame, *order: str | Column) -> DataFrame:
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id carries the partition number in its upper bits and the row number in the lower 33
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id())
    return materialize(ordered).withColumn("_slice", F.shiftright("_id", 33))


def _before(slices: DataFrame, amount: Column) -> DataFrame:
    """Total of ``amount`` in all earlier slices; the input has one row per partition."""
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.groupBy("_slice")
        .agg(amount.alias("_amount"))
        .select("_slice", F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_before"))
    )


def ranked(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in the given total order (needs unique sort keys)."""
    rows = _slices(df, *order)
    local = F.col("_id") - F.shiftleft("_slice", 33)
    return (
        rows.join(F.broadcast(_before(rows, F.count(F.lit(1)))), "_slice")
        .withColumn(name, (F.col("_before") + local).cast("bigint"))
        .drop("_slice", "_id", "_before")
    )


def running_total(df: DataFrame, amount: str, *order: str | Column, name: str) -> DataFrame:
    """Add the running sum of ``amount`` up to and including each row."""
    rows = _slices(df, *order)
    inside = Window.partitionBy("_slice").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(F.broadcast(_before(rows, F.sum(amount))), "_slice")
        .withColumn(name, F.col("_before") + F.sum(amount).over(inside))
        .drop("_slice", "_id", "_before")
    )


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """One row per distinct value, with ids 0..n-1 in the order of the values."""
    return ranked(df.select(column).where(F.col(column).isNotNull()).distinct(), column)


def listed(df: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values of each key in order: ``(key, position, value)``, positions from 0.

    One row per value, so that a key may have any number of them.
    """
    pairs = ranked(df.select(key, value).distinct(), key, value, name="_pos")
    first = pairs.groupBy(key).agg(F.min("_pos").alias("_first"))
    return attach(pairs, first, key).select(key, (F.col("_pos") - F.col("_first")).alias("position"), value)

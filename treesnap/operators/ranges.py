"""Running sums and maxima over ordered rows without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesnap.session import materialize


def _running(df: DataFrame, group: str, order: list[str], value: Column, out: str, fold: Callable, both: Callable) -> DataFrame:
    """Add ``out``: ``fold`` of ``value`` over the rows of the same group that
    come before this one, null where none does. Rows are dealt out by range of
    (group, order) and folded within each range; one value per range and group gives
    what comes before the range. ``order`` is unique within a group."""
    placed = materialize(df.withColumn("_value", value).repartitionByRange(group, *order)
                         .withColumn("_range", F.spark_partition_id()), "ranges")
    whole = placed.groupBy(group, "_range").agg(fold("_value").alias("_all"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(group, "_range", fold("_all").over(before).alias("_offset"))
    within = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("_own", fold("_value").over(within)).join(offsets, [group, "_range"])
            .withColumn(out, both(F.col("_offset"), F.col("_own"))).drop("_value", "_range", "_own", "_offset"))


def running_total(df: DataFrame, group: str, order: list[str], value, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the group's earlier rows, 0 for none."""
    zero = F.lit(0)
    return _running(df, group, order, value, out, F.sum, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def running_max(df: DataFrame, group: str, order: list[str], value, out: str) -> DataFrame:
    """``out``: the greatest ``value`` of the group's earlier rows, null for none."""
    return _running(df, group, order, value, out, F.max, F.greatest)

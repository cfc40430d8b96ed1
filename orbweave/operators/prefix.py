"""Running sums over groups of any size: blocks are summed first, so no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, group: list[str], block: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the running sum of ``value`` within each group, the row itself included.

    ``block`` is a column that never falls along ``order``. Sums of whole blocks are few and are added up by a window over
    them; the rows of a block are added up by themselves and begin where the blocks before it end.
    """
    before, total = f"__{name}_before", f"__{name}_block"
    whole = df.groupBy(*group, block).agg(F.sum(value).alias(total))
    above = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*group, block, F.sum(total).over(above).alias(before))
    inner = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(value).over(inner)
    zero = F.lit(0).cast(starts.schema[before].dataType)
    return df.join(starts, [*group, block]).withColumn(name, own + F.coalesce(before, zero)).drop(before)


def rank_within(df: DataFrame, group: list[str], block: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in its group's order, from 1, by the same two levels."""
    return prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), group, block, order, "__one", name).drop("__one")

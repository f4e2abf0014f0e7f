"""Running values over one order of all rows, without one task that sees them all.

Rows are sorted over partitions and checkpointed with their partition and place. What a running value needs of the rows
before a partition comes from one row per partition; inside, a window over the partition does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.session import checkpointed

PART, AT = "__part", "__at"


def sorted_parts(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in order, with the number of their sorted partition and their place (ascending in the order)."""
    return checkpointed(rows.orderBy(*order).withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(AT, 33)))


def _sides(after: bool) -> tuple[tuple[int, int], tuple[int, int]]:
    """Window bounds over rows of the partition (without the row itself) and over partitions."""
    last, first = Window.unboundedFollowing, Window.unboundedPreceding
    return ((1, last), (1, last)) if after else ((first, -1), (first, -1))


def others(parts: DataFrame, value: str, kind, by: list[str], name: str, after: bool = False) -> DataFrame:
    """Adds `name`: sum or max (`kind`) of `value` over all rows before (or after) the row, by the columns `by`; null if there
    is none. parts: as of sorted_parts(), sorted by the columns `by` first."""
    inside, outside = _sides(after)
    sums = parts.groupBy(*by, PART).agg(kind(value).alias("__v"))
    far = kind("__v").over(Window.partitionBy(*by).orderBy(PART).rowsBetween(*outside))  # a row per partition
    sums = sums.select(*by, PART, far.alias("__far"))
    near = kind(value).over(Window.partitionBy(*by, PART).orderBy(AT).rowsBetween(*inside))
    both = parts.withColumn("__near", near).join(sums, [*by, PART])
    joined = F.greatest("__near", "__far") if kind is F.max else F.coalesce(F.col("__near") + F.col("__far"), F.col("__near"), F.col("__far"))
    return both.withColumn(name, joined).drop("__near", "__far")

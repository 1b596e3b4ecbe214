"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df, stored, with ``name``: the row's place from 0 in the given order (total, or ties fall anyhow but once and for all).

    Ranges of the order are dealt over tasks and sorted there; the place is that in the range plus the sizes of the ranges
    before, a table of a row for each range.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row for each range
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__at")

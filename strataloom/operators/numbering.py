"""Consecutive numbers over a whole table without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def numbered(rows: DataFrame, *order: str, start: int = 0, name: str = "number") -> DataFrame:
    """rows with consecutive numbers from start on, in ascending order of the columns (nulls first).

    Rows are dealt by range and sorted within their tasks; one count per task tells where each one's numbers begin.
    Equal rows are numbered in no particular order among each other.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    met = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.withColumn(name, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start).cast("long")).drop("_part", "_at", "_first")

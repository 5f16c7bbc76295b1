"""Periods of months: union, gaps, sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_months(periods: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Months that any period of a group covers: overlapping and touching periods merge first."""
    good = periods.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = good.withColumn("new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*by, "island").agg((F.max(end) - F.min(start)).alias("months"))
    return merged.groupBy(*by).agg(F.sum("months").cast("long").alias("months"), F.count("*").alias("islands"))


def sum_months(periods: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Months of all periods of a group, overlaps counted every time."""
    return periods.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.coalesce(F.col(end) - F.col(start), F.lit(0)))).cast("long").alias("months"))


def gaps(periods: DataFrame, by: Sequence[str], least: int = 6, start: str = "start", end: str = "end") -> DataFrame:
    """Gaps of ``least`` months or more between one period and the next, as they come: ``gap_year`` and ``gap_months``."""
    order = Window.partitionBy(*by).orderBy(start, end)
    out = periods.withColumn("gap_months", F.lead(start).over(order) - F.col(end))
    return out.where(F.col("gap_months") >= least).select(*by, F.expr(f"`{end}` div 12").cast("long").alias("gap_year"), F.col("gap_months").cast("long").alias("gap_months"))

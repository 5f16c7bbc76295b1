"""Points in intervals: an equi-join on bins whose size fits the intervals.

Intervals are filed under bins of a power of two that about half of them fit into; a
longer one lies in several bins, but all of them together in a few rows an interval.
Lengths that would take more get larger bins of their own. So a point asks one bin
where lengths are of one kind, and a few where they aren't. The exact test follows.
There is no bin width to choose, and no interval is too long.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The least power of two that isn't under ``length``, as its exponent."""
    return F.ceil(F.log2(length.cast("double"))).cast("int")


#: Rows that the bins of intervals may add, for each interval that shares their size, and how many levels below its size an interval may be filed.
EXTRA, BELOW = 2, 10


def grains(counts: dict[int, int]) -> list[tuple[int, int]]:
    """Sizes of bins as exponents, each with the highest level that is filed under it, from how many intervals each level has.

    A size is the median level of the intervals that are left; it takes up to ``BELOW``
    lower levels, and higher ones as long as their bins add ``EXTRA`` rows an interval at
    most. Ascending.
    """
    out, left = [], dict(sorted(counts.items()))
    while left:
        n, seen, extra = sum(left.values()), 0, 0
        for level, count in left.items():
            seen += count
            if 2 * seen >= n:
                break
        size = top = level
        for level in [k for k in left if k > size and not any(size < x < k for x, _ in out)]:
            extra += left[level] * ((1 << level - size) - 1)
            if extra > EXTRA * sum(c for k, c in left.items() if size - BELOW <= k <= level):
                break
            top = level
        out.append((size, top))
        left = {k: c for k, c in left.items() if k > top or k < size - BELOW}
    return sorted(out)


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: Sequence[str], point: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Every point with every interval of its keys that holds it: ``start`` is inside, ``end`` is not.

    All of these are whole numbers. ``how="left"`` keeps points without an interval,
    if points are distinct rows. Null points, bounds and keys, and empty intervals
    meet nothing. How many intervals have each of 64 lengths is the only thing that
    the driver sees. Points of one bin and key are one array, so as many of them as
    stand within about an interval's length must fit a task.
    """
    length = F.col(end) - F.col(start)
    filed = intervals.where((length > 0) & F.col(start).isNotNull()).withColumn("__level", _level(length))
    sizes = grains({r["__level"]: r["n"] for r in filed.groupBy("__level").agg(F.count("*").alias("n")).collect()}) or [(0, 0)]
    bin_of = lambda at: F.call_function("shiftright", at.cast("long"), F.col("__size"))
    size = reduce(lambda rest, x: F.when(F.col("__level") <= x[1], x[0]).otherwise(rest), reversed(sizes), F.lit(None).cast("int"))
    filed = filed.withColumn("__size", size).drop("__level").withColumn("__bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end) - 1))))
    asked = points.where(F.col(point).isNotNull()).withColumn("__size", F.explode(F.array(*[F.lit(x) for x, _ in sizes])) if len(sizes) > 1 else F.lit(sizes[0][0]))
    asked = asked.withColumn("__bin", bin_of(F.col(point)))
    on = [*by, *(["__size"] if len(sizes) > 1 else []), "__bin"]  # a constant in the keys would cost a second shuffle
    # points of a bin travel as one array, bare if they have no other columns
    rest = [c for c in points.columns if c not in by]
    bare = rest == [point]
    packed = asked.groupBy(*on).agg(F.collect_list(F.col(point) if bare else F.struct(*rest)).alias("__points"))
    held = F.filter("__points", lambda p: (F.col(start) <= (p if bare else p[point])) & ((p if bare else p[point]) < F.col(end)))
    ends = [c for c in intervals.columns if c not in by]
    met = filed.join(packed, on).select(*by, *ends, F.explode(held).alias("__point"))
    met = met.select(*by, *([F.col("__point").alias(point)] if bare else ["__point.*"]), *ends)
    return met if how == "inner" else points.join(met, points.columns, "left")

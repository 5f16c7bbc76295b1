"""Cohort statistics: exact percentiles by group with a floor of group size, and positions in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import scores as S

QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
FLOOR = 30
#: Bins between a value and its double.
BINS = 64


def long_form(samples: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row a sample and metric: a single scan, whatever the number of metrics."""
    return samples.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value").where(F.col("value").isNotNull())


def percentiles(samples: DataFrame, keys: Sequence[str], metrics: Sequence[str], floor: int = FLOOR, digits: int = 4) -> DataFrame:
    """Size and interpolated percentiles of every group and metric with ``floor`` values at least.

    Values fall into bins of about 1/``BINS`` of their size; counts of bins say
    which of them hold the wanted places, and only these few bins' values are then
    counted and ranked. No task holds a group, and what is shuffled is counts: the
    largest unit is the distinct values of one bin, sorted with spilling.
    """
    return percentiles_of_counts(long_form(samples, keys, metrics).withColumn("n", F.lit(1)), keys, floor, digits)


def percentiles_of_counts(counts: DataFrame, keys: Sequence[str], floor: int = FLOOR, digits: int = 4) -> DataFrame:
    """The same from values that stand for ``n`` samples each: keys, ``metric``, ``value``, ``n``. A value may have several rows."""
    by = [*keys, "metric"]
    binned = counts.withColumn("bin", _bin(F.col("value").cast("double")))
    last = F.col("sample_size") - 1
    places = [(f"{name}_{end}", F.least(F.floor(last * q) + step, last)) for name, q in QUANTILES.items() for end, step in (("low", 0), ("high", 1))]
    whole = Window.partitionBy(*by)
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    begins = binned.groupBy(*by, "bin").agg(F.sum("n").alias("bin_n"))
    begins = begins.withColumn("begin", F.coalesce(F.sum("bin_n").over(before), F.lit(0))).withColumn("sample_size", F.sum("bin_n").over(whole)).where(F.col("sample_size") >= floor)
    wanted = begins.where(F.exists(F.array(*[p for _, p in places]), lambda p: (F.col("begin") <= p) & (p < F.col("begin") + F.col("bin_n"))))
    counts = _join(binned, wanted.select(*by, "bin", "begin", "sample_size"), [*by, "bin"]).groupBy(*by, "bin", "sample_size", "begin", "value").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*by, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("past", F.col("begin") + F.sum("n").over(within)).withColumn("from", F.col("past") - F.col("n"))
    ends = [F.max(F.when((F.col("from") <= p) & (p < F.col("past")), F.col("value"))).alias(name) for name, p in places]
    out = placed.groupBy(*by, "sample_size").agg(*ends)
    at = lambda n, q: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (last * q - F.floor(last * q))
    return out.select(*by, "sample_size", *[F.round(F.when(F.col(f"{n}_low") == F.col(f"{n}_high"), F.col(f"{n}_low")).otherwise(at(n, q)), digits).alias(n) for n, q in QUANTILES.items()])


def _bin(value: Column) -> Column:
    """A whole number that never falls as the value rises: by sign and logarithm, NaN last."""
    place = F.floor(F.least(F.log2(F.abs(value)) * BINS, F.lit(1100.0 * BINS))).cast("int") + 2000 * BINS
    return F.when(F.isnan(value), 5000 * BINS).when(value == 0, 0).when(value > 0, place).otherwise(-place)


def _join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """An equi-join for which null keys are equal."""
    other = right.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(other, same).drop(*[f"__{c}" for c in by])


def drop_thin(stats: DataFrame, samples: DataFrame, keys: Sequence[str], floor: int = FLOOR) -> DataFrame:
    """Statistics whose group still has ``floor`` samples."""
    valid = samples.groupBy(*keys).count().where(F.col("count") >= floor).select(*keys)
    return stats.join(valid, list(keys), "left_semi")


def attach(scores: DataFrame, stats: DataFrame, keys: Sequence[str], metrics: Sequence[str], floor: int = FLOOR) -> DataFrame:
    """Position of every score in its cohort; scores without a cohort of ``floor`` are left out.

    Statistics are few (cohorts x metrics), so Spark broadcasts them by size.
    """
    others = [c for c in scores.columns if c not in metrics]
    long = scores.unpivot(others, list(metrics), "metric", "value")
    joined = long.join(stats.where(F.col("sample_size") >= floor), [*keys, "metric"])
    return joined.select(*others, "metric", "value", "sample_size", S.percentile_position(F.col("value"), *[F.col(n) for n in QUANTILES]).alias("percentile"))


def refresh(old: DataFrame, samples: DataFrame, keys: Sequence[str], metrics: Sequence[str], floor: int = FLOOR) -> DataFrame:
    """Statistics after a refresh: new ones replace old ones of the same group and metric, and groups that became thin go."""
    new = percentiles(samples, keys, metrics, floor)
    stale = old.join(new.select(*keys, "metric"), [*keys, "metric"], "left_anti")
    return new.unionByName(drop_thin(stale.select(*new.columns), samples, keys, floor))

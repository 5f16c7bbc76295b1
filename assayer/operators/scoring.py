"""Scores: coverage of requirements, deductions, writing quality, the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import scores as S


def job_match(requirements: DataFrame, matches: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Weighted coverage of each pair's requirements, gated by its mandatory ones.

    ``requirements``: keys, ``requirement_id``, ``priority``; ``matches``: keys,
    ``requirement_id``, ``strength``. A requirement without a match counts 0.
    """
    on = [*by, "requirement_id"]
    best = matches.groupBy(*on).agg(F.max("strength").alias("strength"))
    rows = requirements.select(*on, "priority").join(best, on, "left").withColumn("weight", S.priority_weight(F.col("priority"))).withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    return coverage(rows, by)


def rubric(spark: SparkSession, version: str = "default") -> DataFrame:
    """The weights that scores use by default, as a table: ``version``, ``section``, ``name``, ``weight``."""
    sections = {"priority": S.PRIORITY_WEIGHTS, "overall": S.OVERALL_WEIGHTS, "metric": S.METRIC_WEIGHTS, "judgement": S.RUBRIC_WEIGHTS}
    return spark.createDataFrame([(version, section, name, weight) for section, weights in sections.items() for name, weight in weights.items()], "version string, section string, name string, weight double")


def weighted(rows: DataFrame, rubrics: DataFrame, priority: str = "priority") -> DataFrame:
    """``rows`` once for each version of ``rubrics``, with ``version`` and the ``weight`` that it gives their priority; a priority that a version lacks weighs nothing there and gives no row.

    Priorities are few, so the join must not deal rows by them: the weights go to every task.
    """
    weights = rubrics.where("section = 'priority'").select("version", F.col("name").alias(priority), "weight")
    return rows.join(F.broadcast(weights), priority)


def coverage(rows: DataFrame, by: Sequence[str], weight: str = "weight", strength: str = "strength", priority: str = "priority") -> DataFrame:
    """``job_match``, ``uncapped``, ``must_coverage``, ``overall_coverage`` and ``band`` by group, in one aggregation."""
    must, earned = F.col(priority) == "must", F.col(weight) * F.col(strength)
    sums = rows.groupBy(*by).agg(F.sum(weight).alias("w"), F.sum(earned).alias("e"), F.sum(F.when(must, F.col(weight))).alias("mw"), F.sum(F.when(must, earned)).alias("me"))
    must_coverage = F.coalesce(F.try_divide("me", "mw"), F.lit(1.0))
    raw = F.try_divide("e", "w") * 100
    out = sums.withColumn("mc", must_coverage).withColumn("raw", raw).withColumn("capped", S.gated(F.col("raw"), F.col("mc")))
    return out.select(
        *by,
        F.bround("capped", 1).alias("job_match"),
        F.when(F.col("capped") < F.col("raw"), F.bround("raw", 1)).alias("uncapped"),
        F.bround("mc", 4).alias("must_coverage"),
        F.bround(F.col("raw") / 100, 4).alias("overall_coverage"),
        S.band(F.col("capped")).alias("band"),
    )


def ats(findings: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """100 less all deductions, 0 at least; ``deducted`` is their sum."""
    return findings.groupBy(*by).agg(F.coalesce(F.sum("deduction"), F.lit(0.0)).alias("deducted")).withColumn("ats", F.bround(F.greatest(F.lit(0.0), 100 - F.col("deducted")), 1))


def quality(metrics: DataFrame, judgements: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Metrics (keys, ``key``, ``value``) and judgements (keys, five levels; a null or missing row is none) as one score.

    Without a judgement the metrics alone count, with confidence 0.6.
    """
    weight, target, higher = S.lookup(F.col("key"), S.METRIC_WEIGHTS), S.lookup(F.col("key"), {k: t for k, (t, _) in S.METRIC_TARGETS.items()}), S.lookup(F.col("key"), {k: h for k, (_, h) in S.METRIC_TARGETS.items()})
    part = metrics.where(weight.isNotNull()).withColumn("w", weight).withColumn("a", S.attainment(F.col("value"), target, higher))
    counted = part.groupBy(*by).agg((F.try_divide(F.sum(F.col("a") * F.col("w")), F.sum("w")) * 100).alias("metric_part"))
    judged = sum((S.level_percent(F.col(k)) * w for k, w in S.RUBRIC_WEIGHTS.items()), F.lit(0.0))
    out = counted.join(judgements.select(*by, judged.alias("judged_part")), list(by), "full_outer")
    metric = F.coalesce("metric_part", F.lit(0.0))
    value = F.when(F.col("judged_part").isNull(), metric).otherwise(metric * S.QUALITY_SPLIT[0] + F.col("judged_part") * S.QUALITY_SPLIT[1])
    return out.select(*by, F.bround(metric, 1).alias("metric_part"), F.bround(value, 1).alias("quality"), F.when(F.col("judged_part").isNull(), 0.6).otherwise(1.0).alias("confidence"))


def overall(job: Column, quality_: Column, ats_: Column, must_coverage: Column) -> tuple[Column, Column, Column]:
    """Score, band and uncapped score of the whole, from rounded parts, gated once more."""
    raw = job * S.OVERALL_WEIGHTS["job_match"] + quality_ * S.OVERALL_WEIGHTS["quality"] + ats_ * S.OVERALL_WEIGHTS["ats"]
    value = S.gated(raw, must_coverage)
    return F.bround(value, 1), S.band(value), F.when(value < raw, F.bround(raw, 1))


def compute(requirements: DataFrame, matches: DataFrame, findings: DataFrame, metrics: DataFrame, judgements: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """All four scores of every pair that has requirements, findings, metrics or a judgement."""
    on = list(by)
    pairs = job_match(requirements, matches, by).withColumnRenamed("band", "job_band")
    out = pairs.join(ats(findings, by), on, "full_outer").join(quality(metrics, judgements, by), on, "full_outer")
    job = F.coalesce("job_match", F.lit(0.0))
    must = F.coalesce("must_coverage", F.lit(0.0))
    value, band_, uncapped = overall(job, F.coalesce("quality", F.lit(0.0)), F.coalesce("ats", F.lit(100.0)), must)
    return out.select(*on, value.alias("overall"), band_.alias("band"), uncapped.alias("overall_uncapped"), job.alias("job_match"), F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("ats", F.lit(100.0)).alias("ats"), must.alias("must_coverage"), F.coalesce("confidence", F.lit(0.6)).alias("confidence"))


def expected_positions(scored: DataFrame, bands: DataFrame, kinds: Sequence[str] = ("job_match", "quality", "ats")) -> DataFrame:
    """Each score against the range expected of its role and level.

    ``bands``: ``role_family``, ``seniority``, ``kind``, ``low``, ``high``, a
    small table. Role falls back to ``general``, level to ``entry``.
    """
    long = scored.unpivot([c for c in scored.columns if c not in kinds], list(kinds), "kind", "value")
    exact = bands.select("role_family", "seniority", "kind", F.col("low").alias("low1"), F.col("high").alias("high1"))
    entry = bands.where("seniority = 'entry'").select("role_family", "kind", F.col("low").alias("low2"), F.col("high").alias("high2"))
    general = bands.where("role_family = 'general'").select("seniority", "kind", F.col("low").alias("low3"), F.col("high").alias("high3"))
    last = bands.where("role_family = 'general' AND seniority = 'entry'").select("kind", F.col("low").alias("low4"), F.col("high").alias("high4"))
    known = bands.select("role_family").distinct().withColumn("known", F.lit(True))
    out = long.join(known, "role_family", "left").join(exact, ["role_family", "seniority", "kind"], "left").join(entry, ["role_family", "kind"], "left").join(general, ["seniority", "kind"], "left").join(last, ["kind"], "left")
    pick = lambda n: F.when(F.col("known"), F.coalesce(f"{n}1", f"{n}2")).otherwise(F.coalesce(f"{n}3", f"{n}4"))
    keys = [c for c in scored.columns if c not in kinds]
    return out.select(*keys, "kind", "value", pick("low").alias("low"), pick("high").alias("high"), S.within(F.col("value"), pick("low"), pick("high")).alias("position"))

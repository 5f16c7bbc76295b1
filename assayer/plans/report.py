"""From texts and requirements to nested reports, as one declarative plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import advice, matching, scoring, writing
from assayer.sources.kept import keep


def ordered(rows: DataFrame, by: Sequence[str], name: str, *columns: str, order: Sequence[str]) -> DataFrame:
    """Rows of a group as one array column ``name``, in ``order``."""
    items = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))))
    return rows.groupBy(*by).agg(F.transform(items, lambda x: x["v"]).alias(name))


def analyse(requirements: DataFrame, skills: DataFrame, edges: DataFrame, bullets: DataFrame, findings: DataFrame, judgements: DataFrame, by: Sequence[str] = ("pair_id",), taxonomy: DataFrame | None = None, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """Matches, metrics, scores, verdicts and recommendations of every pair.

    ``requirements``: keys, ``requirement_id``, ``canonical``, ``priority``,
    ``years`` and, for titles and verdicts that name them, ``text``; ``skills``, ``edges``, ``taxonomy``, ``documents`` (and the
    ``text`` and ``category`` that the latter two need): see
    ``matching.cascade``; ``bullets``: keys,
    ``ord``, ``text``; ``findings``: keys, ``rule_id``, ``deduction``;
    ``judgements``: keys and five levels.

    What several parts need (matches, metrics, findings, scores, rated requirements) is written
    once and read back, so that no part computes it again and no plan holds the whole chain.
    """
    matches = keep(matching.cascade(requirements, skills, edges, by, taxonomy, documents), "report-matches")
    wide = keep(writing.metrics(bullets, by), "report-metrics")
    metrics, findings = writing.long_metrics(wide, by), keep(findings.select(*by, "rule_id", "deduction"), "report-findings")
    scores = keep(scoring.compute(requirements, matches, findings, metrics, judgements, by), "report-scores")
    named = F.col("text") if "text" in requirements.columns else F.concat(F.lit("requirement "), F.col("requirement_id").cast("string"))
    listed = F.coalesce(F.col("origin").isin("skills_list", "other"), F.lit(False)).alias("listed_only")
    rated = keep(requirements.select(*by, "requirement_id", "priority", named.alias("text")).join(matches.select(*by, "requirement_id", "strength", "status", listed), [*by, "requirement_id"]), "report-rated")
    errors = writing.flags(bullets, by, ["error"]).groupBy(*by).agg(F.count_distinct("kind", F.lower("found")).alias("errors"))
    judged = judgements.select(*by, sum((((F.col(k) - 1) / 4.0 * 100) * w for k, w in scoring.S.RUBRIC_WEIGHTS.items()), F.lit(0.0)).alias("judged_part"))
    wanted = advice.requirement_gains(rated, scores, by).join(rated.select(*by, "requirement_id", "text", "status", "listed_only"), [*by, "requirement_id"])
    gains = advice.candidates(wanted, advice.rule_gains(findings, scores, by), advice.metric_gains(metrics, scores, judged, by), by, errors)
    facts = advice.facts(rated, by).join(advice.gaps(rated, by), list(by)).join(scores.select(*by, "overall", "band", "ats", "quality", F.col("overall_uncapped").isNotNull().alias("capped")), list(by))
    return {"matches": matches, "metrics": metrics, "metric_arrays": writing.metric_array(wide, by), "scores": scores, "facts": advice.verdicts(facts), "recommendations": advice.top(gains, by)}


def nest(parts: dict[str, DataFrame], by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """One row a pair with its scores, matches, metrics and recommendations as arrays: one aggregate a child, then left joins on the key."""
    on = list(by)
    out = parts["scores"].select(*on, F.struct("overall", "band", "job_match", "quality", "ats", "must_coverage", "confidence").alias("scores"))
    out = out.join(ordered(parts["matches"], on, "matches", "requirement_id", "status", "strength", "is_adjacent", order=["requirement_id"]), on, "left")
    out = out.join(parts["metric_arrays"], on, "left")
    out = out.join(ordered(parts["recommendations"], on, "recommendations", "key", "title", "severity", "gain", order=["rank"]), on, "left")
    return out.join(advice.headline(parts["facts"]).select(*on, "headline", "verdict", "strengths", "weaknesses"), on, "left")

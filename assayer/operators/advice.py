"""What-if projections in closed form, and recommendations ranked by gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import scores as S
from assayer.functions import text as T
from assayer.operators.scoring import overall

MEANINGFUL = 0.5


def requirement_gains(requirements: DataFrame, scores: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Gain in the overall score if a requirement were fully met, for each requirement below full strength.

    ``requirements``: keys, ``requirement_id``, ``priority``, ``strength``;
    ``scores``: keys, ``overall``, ``quality``, ``ats``. The sums of a pair are
    a grouped aggregate joined back, so a pair of any size is no single task.
    """
    weight, must = S.priority_weight(F.col("priority")), F.col("priority") == "must"
    rows = requirements.withColumn("w", weight).withColumn("s", F.coalesce("strength", F.lit(0.0)))
    sums = rows.groupBy(*by).agg(F.sum("w").alias("tw"), F.sum(F.col("w") * F.col("s")).alias("te"), F.sum(F.when(must, F.col("w")).otherwise(0.0)).alias("mw"), F.sum(F.when(must, F.col("w") * F.col("s")).otherwise(0.0)).alias("me"))
    more = F.col("w") * (1 - F.col("s"))
    out = rows.where("s < 0.99").join(sums, list(by)).join(scores, list(by))
    must_coverage = F.coalesce(F.try_divide(F.col("me") + F.when(must, more).otherwise(0.0), "mw"), F.lit(1.0))
    out = out.withColumn("mc", must_coverage).withColumn("job", F.bround(S.gated((F.col("te") + more) / F.col("tw") * 100, F.col("mc")), 1))
    value, _, _ = overall(F.col("job"), F.col("quality"), F.col("ats"), F.col("mc"))
    return out.select(*by, "requirement_id", "priority", value.alias("projected"), gain(value, F.col("overall")).alias("gain"))


def gain(projected, base):
    """What a change adds: never below 0, to one digit."""
    return F.bround(F.greatest(F.lit(0.0), projected - base), 1)


def rule_gains(findings: DataFrame, scores: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Gain if all findings of a rule were gone: the floor of 0 applies after, so deductions beyond it count nothing."""
    per_rule = findings.groupBy(*by, "rule_id").agg(F.sum("deduction").alias("own"), F.max("deduction").alias("largest"))
    total = findings.groupBy(*by).agg(F.sum("deduction").alias("all"))
    out = per_rule.join(total, list(by)).join(scores, list(by)).withColumn("fixed", F.bround(F.greatest(F.lit(0.0), 100 - (F.col("all") - F.col("own"))), 1))
    value, _, _ = overall(F.col("job_match"), F.col("quality"), F.col("fixed"), F.col("must_coverage"))
    return out.select(*by, "rule_id", "largest", "fixed", value.alias("projected"), gain(value, F.col("overall")).alias("gain"))


def metric_gains(metrics: DataFrame, scores: DataFrame, judged: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Gain if a failing metric (keys, ``key``, ``value``) reached its target. ``judged``: keys, ``judged_part`` (null: none)."""
    w = S.lookup(F.col("key"), S.METRIC_WEIGHTS)
    target, higher = S.lookup(F.col("key"), {k: t for k, (t, _) in S.METRIC_TARGETS.items()}), S.lookup(F.col("key"), {k: h for k, (_, h) in S.METRIC_TARGETS.items()})
    rows = metrics.where(w.isNotNull()).withColumn("w", w).withColumn("a", S.attainment(F.col("value"), target, higher))
    sums = rows.groupBy(*by).agg(F.sum("w").alias("tw"), F.sum(F.col("w") * F.col("a")).alias("ta"))
    out = rows.where("a < 1").join(sums, list(by)).join(scores, list(by)).join(judged, list(by), "left")
    part = (F.col("ta") + F.col("w") * (1 - F.col("a"))) / F.col("tw") * 100
    quality = F.bround(F.when(F.col("judged_part").isNull(), part).otherwise(part * S.QUALITY_SPLIT[0] + F.col("judged_part") * S.QUALITY_SPLIT[1]), 1)
    value, _, _ = overall(F.col("job_match"), quality, F.col("ats"), F.col("must_coverage"))
    return out.select(*by, "key", value.alias("projected"), gain(value, F.col("overall")).alias("gain"))


def clean_layout_gain(scores: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Gain if no rule fired at all."""
    value, _, _ = overall(F.col("job_match"), F.col("quality"), F.lit(100.0), F.col("must_coverage"))
    return scores.select(*by, value.alias("projected"), gain(value, F.col("overall")).alias("gain"))


def candidates(requirement: DataFrame, rule: DataFrame, metric: DataFrame, by: Sequence[str] = ("pair_id",), proofread: DataFrame | None = None) -> DataFrame:
    """Meaningful gains of all kinds in one form: keys, ``key``, ``title``, ``severity``, ``gain``, ``tier``.

    ``requirement`` may have ``text`` (else its id is named), ``status`` and
    ``listed_only``, which choose the wording; ``proofread``: keys and ``errors``
    (a count). Spelling isn't scored, so it comes last, with a gain of 0, as one
    recommendation for all errors.
    """
    severity = F.when(F.col("priority") == "must", "high").when(F.col("priority") == "strong", "medium").otherwise("low")
    name = F.col("text") if "text" in requirement.columns else F.concat(F.lit("requirement "), F.col("requirement_id").cast("string"))
    title = F.concat(F.lit("Strengthen the evidence for "), name)
    if "status" in requirement.columns:
        title = F.when(F.col("status") == "missing", F.concat(F.lit("Add what is missing: "), name)).otherwise(title)
    if "listed_only" in requirement.columns:
        title = F.when(F.col("listed_only"), F.concat(F.lit("Show where you used "), name)).otherwise(title)
    a = requirement.select(*by, F.concat(F.lit("req:"), F.col("requirement_id").cast("string")).alias("key"), title.alias("title"), severity.alias("severity"), "gain", F.lit(0).alias("tier"))
    b = rule.select(*by, F.concat(F.lit("ats:"), "rule_id").alias("key"), F.concat(F.lit("Fix "), F.replace("rule_id", F.lit("_"), F.lit(" "))).alias("title"), F.when(F.col("largest") >= 15, "high").otherwise("medium").alias("severity"), "gain", F.lit(1).alias("tier"))
    c = metric.select(*by, F.concat(F.lit("metric:"), "key").alias("key"), F.concat(F.lit("Improve "), F.replace("key", F.lit("_"), F.lit(" "))).alias("title"), F.lit("medium").alias("severity"), "gain", F.lit(2).alias("tier"))
    out = a.unionByName(b).unionByName(c).where(F.col("gain") >= MEANINGFUL)
    if proofread is None:
        return out
    noun = F.when(F.col("errors") == 1, "error").otherwise("errors")
    d = proofread.where("errors > 0").select(*by, F.lit("writing:proofread").alias("key"), F.concat(F.format_string("Fix %d spelling and punctuation ", "errors"), noun).alias("title"), F.lit("medium").alias("severity"), F.lit(0.0).alias("gain"), F.lit(3).alias("tier"))
    return out.unionByName(d)


def top(candidates_: DataFrame, by: Sequence[str] = ("pair_id",), limit: int = 6) -> DataFrame:
    """The ``limit`` best of each group: by gain, tier, title; of equal keys, then of equal titles, only the first."""
    order = [F.desc("gain"), "tier", "title", "key"]
    first = lambda df, *keys: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    unique = first(first(candidates_, *by, "key").withColumn("__title", F.lower(F.trim("title"))), *by, "__title").drop("__title")
    return unique.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def total_gain(candidates_: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    return candidates_.groupBy(*by).agg(F.bround(F.sum("gain"), 1).alias("available"))


def facts(requirements: DataFrame, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Counts by status, and of mandatory requirements, in one aggregation. ``requirements``: keys, ``priority``, ``status``."""
    count = lambda c: F.count_if(c)
    return requirements.groupBy(*by).agg(F.count("*").alias("total"), count(F.col("status") == "matched").alias("matched"), count(F.col("status") == "partial").alias("partial"), count(F.col("status") == "missing").alias("missing"), count(F.col("priority") == "must").alias("must_total"), count((F.col("priority") == "must") & (F.col("status") == "matched")).alias("must_matched"))


def gaps(requirements: DataFrame, by: Sequence[str] = ("pair_id",), limit: int = 3) -> DataFrame:
    """The first ``limit`` missing mandatory requirements and skills listed but not shown, as arrays ``top_gaps`` and ``listed``. ``requirements``: keys, ``requirement_id``, ``text``, ``priority``, ``status``, ``strength``."""
    first = lambda c: F.transform(F.slice(F.array_compact(F.sort_array(F.collect_list(F.when(c, F.struct("requirement_id", "text"))))), 1, limit), lambda x: x["text"])
    missing = (F.col("priority") == "must") & (F.col("status") == "missing")
    listed = (F.col("status") == "partial") & (F.col("strength") > 0) & (F.col("strength") <= 0.5)
    return requirements.groupBy(*by).agg(first(missing).alias("top_gaps"), first(listed).alias("listed"))


def _score(column: str) -> Column:
    """A score of one digit as text, without a zero behind the point."""
    return F.regexp_replace(F.format_string("%.1f", F.col(column).cast("double")), r"\.0$", "")


def verdicts(facts_: DataFrame) -> DataFrame:
    """``facts_`` with ``verdict`` (a paragraph), and arrays ``strengths`` and ``weaknesses``, all from computed values.

    ``facts_``: what ``facts`` and ``gaps`` give, with ``overall``, ``band``,
    ``ats``, ``quality`` and ``capped``. No sentence is written to encourage: a
    list may be empty.
    """
    must = F.col("must_total") > 0
    all_met = must & (F.col("must_matched") == F.col("must_total"))
    plural = lambda n, one, many: F.when(n == 1, one).otherwise(many)
    n_gaps, n_listed = F.size("top_gaps"), F.size("listed")
    sentences = [
        F.concat(F.replace("band", F.lit("_"), F.lit(" ")), F.lit(": "), _score("overall"), F.lit(" of 100.")),
        F.when(must, F.concat(F.format_string("%d of %d essential ", "must_matched", "must_total"), plural(F.col("must_total"), "requirement", "requirements"), F.lit(" met."))),
        F.when(F.col("capped"), "The score is capped: optional requirements don't make up for essential ones."),
        F.when(n_gaps > 0, F.concat(F.lit("What matters most: "), F.array_join("top_gaps", ", "), F.lit("."))),
        F.when(n_listed > 0, F.concat(F.lit("Listed but not shown in use: "), F.array_join("listed", ", "), F.lit("."))),
        F.when(F.col("ats") < 80, F.concat(F.lit("The layout scores "), _score("ats"), F.lit(", the cheapest part to mend."))).when(F.col("ats") >= 95, "The layout loses nothing."),
        F.when(F.col("quality") < 60, "The writing tells duties more than results."),
    ]
    strong = [
        F.when(all_met, F.format_string("All %d essential requirements are met.", "must_total")).when(F.col("must_matched") > 0, F.format_string("%d of %d essential requirements are met.", "must_matched", "must_total")),
        F.when(F.col("ats") >= 95, "The document parses without loss."),
        F.when(F.col("quality") >= 75, F.concat(F.lit("The writing scores "), _score("quality"), F.lit("."))),
        F.when(F.col("matched") >= 5, F.format_string("%d requirements are shown, not only claimed.", "matched")),
    ]
    weak = [
        F.when(F.col("missing") > 0, F.concat(F.format_string("%d ", "missing"), plural(F.col("missing"), "requirement", "requirements"), F.lit(" without any evidence."))),
        F.when(n_listed > 0, F.concat(n_listed.cast("string"), F.lit(" "), plural(n_listed, "skill", "skills"), F.lit(" listed but never shown."))),
        F.when(F.col("ats") < 80, F.concat(F.lit("The layout scores "), _score("ats"), F.lit("."))),
        F.when(F.col("quality") < 65, F.concat(F.lit("The writing scores "), _score("quality"), F.lit("."))),
    ]
    kept = lambda texts: F.array_compact(F.array(*texts))
    return facts_.withColumns({"verdict": F.array_join(kept(sentences), " "), "strengths": kept(strong), "weaknesses": kept(weak)})


def prose_is_grounded(text: Column, allowed: Column) -> Column:
    """Whether every number of ``text`` is one of ``allowed`` (an array of numbers), as it is or with ``%``."""
    known = F.transform(allowed, lambda x: T.six_digits(x.cast("double")))
    return F.size(F.array_except(T.number_facts(text), F.concat(known, F.transform(known, lambda x: F.concat(x, F.lit("%")))))) == 0


def headline(facts_: DataFrame) -> DataFrame:
    """A sentence on each row of ``facts``."""
    noun = F.when(F.col("total") == 1, "requirement").otherwise("requirements")
    gap = F.when(F.col("missing") > 0, F.format_string("%d missing", "missing"))
    half = F.when(F.col("partial") > 0, F.format_string("%d in part", "partial"))
    return facts_.withColumn("headline", F.concat_ws(", ", F.concat(F.format_string("%d of %d ", "matched", "total"), noun, F.lit(" met")), gap, half))

"""Score arithmetic: attainment, gates, bands, positions, strengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rubric.
PRIORITY_WEIGHTS = {"must": 3.0, "strong": 2.0, "nice": 1.0}
GATES = ((0.50, 55.0), (0.70, 72.0))
OVERALL_WEIGHTS = {"job_match": 0.45, "quality": 0.35, "ats": 0.20}
METRIC_WEIGHTS = {"quantification": 0.25, "action_verbs": 0.20, "weak_phrases": 0.20, "bullet_length": 0.12, "passive_voice": 0.10, "first_person": 0.07, "opener_variety": 0.06}
METRIC_TARGETS = {"quantification": (0.40, True), "action_verbs": (0.80, True), "bullet_length": (0.75, True), "weak_phrases": (0.0, False), "passive_voice": (0.10, False), "first_person": (0.0, False), "opener_variety": (0.80, True)}
RUBRIC_WEIGHTS = {"impact": 0.30, "clarity": 0.25, "specificity": 0.25, "professionalism": 0.10, "relevance": 0.10}
QUALITY_SPLIT = (0.60, 0.40)
BANDS = ((85, "strong"), (70, "competitive"), (55, "needs_work"), (40, "significant_gaps"))
ORIGINS = {"experience_bullet": (1.00, 6), "project_bullet": (0.85, 5), "certification": (0.80, 4), "summary": (0.60, 3), "skills_list": (0.50, 2), "education": (0.50, 2), "other": (0.40, 1)}
ADJACENT_STRENGTH, CLOSE_RATIO, CLOSE_STRENGTH, SHORT_STRENGTH = 0.40, 0.6, 0.6, 0.3


def lookup(of: Column, values: dict, default=None) -> Column:
    """The value that ``values`` has for ``of``."""
    out = None
    for key, value in values.items():
        out = F.when(of == key, value) if out is None else out.when(of == key, value)
    return out.otherwise(default) if default is not None else out


def priority_weight(priority: Column) -> Column:
    return lookup(priority, PRIORITY_WEIGHTS)


def origin_strength(origin: Column) -> Column:
    return lookup(origin, {k: v for k, (v, _) in ORIGINS.items()})


def origin_rank(origin: Column) -> Column:
    return lookup(origin, {k: v for k, (_, v) in ORIGINS.items()})


def attainment(value: Column, target: Column, higher_is_better: Column) -> Column:
    """How near a metric is to its target, 0 to 1."""
    above = F.when(target == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(value, target)))
    below = F.when(value <= target, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (value - target) / F.greatest(target, F.lit(0.1))))
    return F.when(higher_is_better, above).otherwise(below)


def gated(raw: Column, must_coverage: Column) -> Column:
    """``raw`` under the cap that low coverage of mandatory requirements sets."""
    out = raw
    for below, cap in GATES:
        out = F.when((must_coverage < below) & (out > cap), cap).otherwise(out)
    return out


def band(value: Column) -> Column:
    out = None
    for least, name in BANDS:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise("not_aligned")


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low")


def within(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "below").when(value > high, "above").otherwise("within")


def level_percent(level: Column) -> Column:
    """Levels 1 to 5 as 0 to 100."""
    return (level - 1) / 4.0 * 100


def percentile_position(value: Column, p10: Column, p25: Column, p50: Column, p75: Column, p90: Column) -> Column:
    """Where a value lies between the five percentiles of its cohort, interpolated; 10 below, 90 above."""
    points = [(p10, 10.0), (p25, 25.0), (p50, 50.0), (p75, 75.0), (p90, 90.0)]
    out = F.when(value <= p10, 10.0)
    for (low, a), (high, b) in zip(points, points[1:]):
        out = out.when(value <= high, F.when(high <= low, b).otherwise(F.bround(a + F.try_divide(value - low, high - low) * (b - a), 1)))
    return F.when(value.isNotNull() & p10.isNotNull(), out.otherwise(90.0))


def with_years(strength: Column, years: Column, months: Column) -> Column:
    """Strength under a requirement of years: kept if met, at most 0.6 if nearly, else at most 0.3."""
    needed = (years * 12).cast("int")
    ratio = F.coalesce(F.try_divide(F.greatest(months, F.lit(0)).cast("double"), needed), F.lit(0.0))
    return F.when(strength.isNull(), None).when(years.isNull() | (F.greatest(months, F.lit(0)) >= needed), strength).when(ratio >= CLOSE_RATIO, F.least(strength, F.lit(CLOSE_STRENGTH))).otherwise(F.least(strength, F.lit(SHORT_STRENGTH)))


def match_status(strength: Column) -> Column:
    return F.when(strength.isNull() | (strength <= 0), "missing").when(strength > 0.5, "matched").otherwise("partial")


def verdict_strength(verdict: Column, evidence: Column) -> Column:
    """yes 1, partial 0.5, else 0; never more than the evidence."""
    return F.least(lookup(F.lower(F.trim(verdict)), {"yes": 1.0, "partial": 0.5}, 0.0), evidence)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 to 1; 0 if lengths differ or one is empty or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    value = F.try_divide(dot, norm(a) * norm(b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))))


def similarity_band(value: Column, accept: float = 0.82, doubt: float = 0.62) -> Column:
    """Bands of a cosine, rounded to four digits first."""
    v = F.bround(value, 4)
    return F.when(v >= accept, "accepted").when(v >= doubt, "ambiguous").otherwise("rejected")


def round_half_even(value: Column | str, digits: int = 0) -> Column:
    """``value`` (a double) rounded to ``digits`` decimals by its exact binary value; true ties go to the even digit.

    The scaled value is a product and its error, both exact (the factors are split in
    halves of 26 bits), so a value just off a tie goes the way it lies. Values beyond
    2**52 units have no decimals to lose and stay, as do NaN and infinities.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    split = 134217729.0
    high = lambda x: x * split - (x * split - x)
    s_high = scale * split - (scale * split - scale)
    s_low = scale - s_high
    product = value * scale
    v_high = high(value)
    v_low = value - v_high
    error = ((v_high * s_high - product) + v_high * s_low + v_low * s_high) + v_low * s_low
    whole = F.floor(product).cast("double")
    over = (product - whole) - 0.5
    up = (over > 0) | ((over == 0) & (error > 0)) | ((over == 0) & (error == 0) & (whole % 2 != 0))
    near = (whole + up.cast("double")) / scale
    return F.when(F.isnan(value) | (F.abs(product) >= 4503599627370496.0), value).otherwise(near)

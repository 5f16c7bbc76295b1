"""Shared reports, anonymous samples, stored history: who may see what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import privacy as P
from assayer.functions import scores as S
from assayer.functions import text as T
from assayer.functions.dates import expiry

MODES = ("full_identified", "identity_redacted", "scores_only")


def secure_view(table: DataFrame, user_id, column: str = "user_id") -> DataFrame:
    """Rows of one user: the only way queries read a user's table."""
    return table.where(F.col(column) == F.lit(user_id))


def live(links: DataFrame, now: Column) -> DataFrame:
    """Links that are neither revoked nor expired."""
    return links.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def resolve(links: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """Reports behind live links, with the link's mode; unknown, revoked and expired tokens give nothing alike."""
    return live(links, now).select("token", "analysis_id", "visibility_mode").join(reports, "analysis_id")


def redact_free_text(rows: DataFrame, columns: Sequence[str], secrets: str = "secrets", mode: str = "visibility_mode") -> DataFrame:
    """Free text by mode: whole, without identifying strings, or without these and quotes."""
    out = {}
    for c in columns:
        clean = P.scrub(F.col(c), F.col(secrets))
        out[c] = F.when(F.col(mode) == MODES[0], F.col(c)).when(F.col(mode) == MODES[2], T.strip_quotes(clean)).otherwise(clean)
    return rows.withColumns(out)


def redact_report(report: DataFrame, mode: str = "visibility_mode") -> DataFrame:
    """Nested reports by mode.

    Columns: ``contact`` (name, email, phone, location, links), ``experience``
    (array of organization, bullets), ``education`` (array of institution),
    ``matches`` (array of requirement_id, strength, explanation, quotes),
    ``recommendations`` (array of title, detail), ``verdict``. The strictest mode
    first redacts identity, then drops what quotes the document.
    """
    c = F.col("contact")
    secrets = P.identifying(c["name"], c["email"], c["phone"], c["links"], F.transform("experience", lambda e: e["organization"]), F.transform("education", lambda e: e["institution"]))
    rows = report.withColumn("__s", secrets)
    scrub = lambda t: P.scrub(t, F.col("__s"))
    full, strict = F.col(mode) == MODES[0], F.col(mode) == MODES[2]
    mark = lambda v, m: F.when(v.isNotNull(), F.lit(m))
    contact = F.struct(mark(c["name"], "[name]").alias("name"), mark(c["email"], "[removed]").alias("email"), mark(c["phone"], "[removed]").alias("phone"), c["location"].alias("location"), F.transform(c["links"], lambda _: F.lit("[removed]")).alias("links"))
    experience = F.transform("experience", lambda e: F.struct(mark(e["organization"], "[organization]").alias("organization"), F.transform(e["bullets"], scrub).alias("bullets")))
    education = F.transform("education", lambda e: F.struct(mark(e["institution"], "[organization]").alias("institution")))
    matches = F.transform("matches", lambda m: F.struct(m["requirement_id"].alias("requirement_id"), m["strength"].alias("strength"), F.when(~strict, scrub(m["explanation"])).alias("explanation"), F.when(strict, F.array().cast("array<string>")).otherwise(F.transform(m["quotes"], scrub)).alias("quotes")))
    recommendations = F.transform("recommendations", lambda r: F.struct(scrub(r["title"]).alias("title"), F.when(strict, T.strip_quotes(scrub(r["detail"]))).otherwise(scrub(r["detail"])).alias("detail")))
    empty = lambda new, name: F.when(strict, F.filter(new, lambda _: F.lit(False))).otherwise(new)
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("email", "string"), ("phone", "string"), ("location", "string"))], F.array().cast("array<string>").alias("links"))
    new = {"contact": F.when(strict, none).otherwise(contact), "experience": empty(experience, "experience"), "education": empty(education, "education"), "matches": matches, "recommendations": recommendations, "verdict": scrub(F.col("verdict"))}
    return rows.withColumns({n: F.when(full, F.col(n)).otherwise(v) for n, v in new.items()}).drop("__s")


def refusal(confidences: Sequence[Column], overall: Column) -> Column:
    """Why a score is no sample: low confidence or no score; null if it is one."""
    return F.when(F.least(*confidences) < 0.9, "low_confidence").when(overall == 0, "no_score")


def anonymous_sample(rows: DataFrame, scores: Sequence[str], when: str) -> DataFrame:
    """Samples that name nobody: whole points, two digits of coverage, the hour; only cohort keys stay."""
    return rows.select("role_family", "seniority", *[F.bround(F.col(c), 0).alias(c) for c in scores], F.bround("must_coverage", 2).alias("must_coverage"), F.date_trunc("HOUR", F.col(when)).alias("created_at"))


def history(analyses: DataFrame, user, limit: int = 20, offset: int = 0, most: int = 50) -> DataFrame:
    """A page of one user's analyses, newest first; the report column is never read."""
    return secure_view(analyses, user).select("id", "created_at", "status", "scores").orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(limit, most))


def cached(analyses: DataFrame, by: Sequence[str], now: Column, days: int = 14) -> DataFrame:
    """The newest finished analysis of each content hash, if it is at most ``days`` old."""
    fresh = analyses.where((F.col("status") == "complete") & (F.col("created_at") >= now - F.make_dt_interval(F.lit(days))))
    order = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("id"))
    return fresh.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def uncached(texts: DataFrame, cache: DataFrame, column: str) -> DataFrame:
    """Distinct texts, by embedding key, that the cache lacks: what a model must still embed."""
    keyed = texts.where(F.col(column).isNotNull()).select(P.embedding_key(F.col(column)).alias("key"), F.col(column))
    return keyed.groupBy("key").agg(F.min(column).alias(column)).join(cache.select("key").distinct(), "key", "left_anti")


def written_back(cache: DataFrame, embedded: DataFrame) -> DataFrame:
    """The cache (``key``, ``vector``) with new vectors for keys that it lacks, one a key: of several the one that sorts first. Its own rows stay."""
    new = embedded.where(F.col("key").isNotNull() & F.col("vector").isNotNull()).groupBy("key").agg(F.min("vector").alias("vector"))
    return cache.select("key", "vector").unionByName(new.join(cache.select("key").distinct(), "key", "left_anti"))


def with_vectors(texts: DataFrame, cache: DataFrame, column: str) -> DataFrame:
    """``texts`` with the ``vector`` that the cache has for each; null for null and blank texts, and for ones that it lacks.

    Distinct texts meet the cache, so one that stands in very many rows is looked up
    once; rows then meet their distinct text by its key. Keys of the cache are unique.
    """
    key = F.when(F.trim(column) != "", P.embedding_key(F.col(column)))
    rows = texts.withColumn("__key", key)
    found = rows.select("__key").where(F.col("__key").isNotNull()).distinct().join(cache.select(F.col("key").alias("__key"), "vector"), "__key")
    return rows.join(found, "__key", "left").drop("__key")


def new_links(analyses: DataFrame, now: Column, days: Column, mode: Column, secret: str) -> DataFrame:
    """A link for each analysis (``id``, ``user_id``): ``token``, expiry of 1 to 30 days, mode; not revoked.

    The token is a keyed hash, so a task that runs again makes the same one.
    """
    token = F.translate(F.replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(secret), F.lit("\0"), F.col("id").cast("string")).cast("binary"), 256))), F.lit("="), F.lit("")), "+/", "-_")
    return analyses.select(token.alias("token"), F.col("id").alias("analysis_id"), "user_id", mode.alias("visibility_mode"), now.alias("created_at"), expiry(now, days).alias("expires_at"), F.lit(None).cast("timestamp").alias("revoked_at"), F.lit(0).cast("long").alias("view_count"))


def revoke(links: DataFrame, token: str, user, now: Column) -> DataFrame:
    """Links with one of a user's own revoked."""
    hit = (F.col("token") == token) & (F.col("user_id") == F.lit(user)) & F.col("revoked_at").isNull()
    return links.withColumn("revoked_at", F.when(hit, now).otherwise(F.col("revoked_at")))


def newest(links: DataFrame, user, limit: int = 50) -> DataFrame:
    """A user's newest links."""
    return secure_view(links, user).orderBy(F.desc("created_at"), "token").limit(limit)


def with_parents(analyses: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Analyses (``resume_id``, ``job_id``) with their document's and posting's columns; ones whose parents are gone stay out. The parents' keys are unique."""
    return analyses.join(resumes, "resume_id").join(jobs, "job_id")


def thread(rows: DataFrame, by: Sequence[str] = ("pair_id",), limit: int = 8) -> DataFrame:
    """The first ``limit`` requirements of each group with their match: by priority, then the unmet first, then by id. ``rows``: keys, ``requirement_id``, ``priority``, ``status``."""
    order = Window.partitionBy(*by).orderBy(S.lookup(F.col("priority"), {"must": 0, "strong": 1}, 2), S.lookup(F.col("status"), {"missing": 0, "partial": 1}, 2), "requirement_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)

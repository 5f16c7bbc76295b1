"""Structured documents: bullets in order, claims located in their text, prompts, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators import matching

#: Stages in order with the percentage shown for each.
STAGES = {"validating": 5, "extracting": 15, "structuring": 35, "reading_job": 45, "matching": 65, "checking_ats": 72, "assessing_quality": 82, "scoring": 90, "writing_advice": 97, "done": 100}
#: Characters of a document, a posting and bullets that a prompt may hold.
PROMPT_LIMITS = {"resume": 24_000, "posting": 16_000, "bullets": 12_000}


def all_bullets(summary: DataFrame, experience: DataFrame, projects: DataFrame, education: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Bullets of all parts in reading order: id, ``origin``, ``ord`` (from 0), ``text``; blank ones are left out.

    Each part: id, ``item`` (its place), ``bullets`` (array of strings).
    """
    parts = [("summary", summary), ("experience_bullet", experience), ("project_bullet", projects), ("education", education)]
    out = None
    for k, (origin, df) in enumerate(parts):
        rows = df.select(id_col, F.lit(k).alias("__part"), "item", F.posexplode("bullets").alias("__pos", "text"), F.lit(origin).alias("origin"))
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy(id_col).orderBy("__part", "item", "__pos")
    return out.where(F.trim("text") != "").withColumn("ord", F.row_number().over(order) - 1).select(id_col, "origin", "ord", "text")


def located(claims: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Claims (id, ``text``) with ``start`` and ``end`` in their document; null if they aren't in it: unverified.

    Found as they are, trimmed, or with other white space between words.
    """
    sources = docs.select(F.col(id_col), F.col("text").alias("__source"))
    start = T.locate(F.col("__source"), F.col("text"))
    out = claims.join(sources, id_col, "left").withColumn("start", start)
    loose = F.regexp_replace(F.regexp_replace(F.trim("text"), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    found = F.call_function("regexp_extract", F.expr("substring(__source, cast(start as int) + 1)"), F.concat(F.lit("(?s)^"), loose), F.lit(0))
    exact = F.expr("substring(__source, cast(start as int) + 1, length(text))") == F.col("text")
    return out.withColumn("end", F.when(exact, F.col("start") + F.length("text")).otherwise(F.col("start") + F.length(found))).drop("__source")


def verified_share(claims: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Share of located claims of each document; 1 with none reported is up to the caller's join."""
    return claims.groupBy(id_col).agg(F.bround(F.avg(F.col("start").isNotNull().cast("int")), 3).alias("span_verification"))


def contexts(experience: DataFrame, projects: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What a rewrite of a bullet may name besides: id, ``origin``, ``item``, ``context``.

    ``experience``: id, ``item``, ``title``, ``organization``; ``projects``: id,
    ``item``, ``name``. Missing parts are left out; without any the context is empty.
    """
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    work = experience.select(id_col, F.lit("experience_bullet").alias("origin"), "item", F.concat_ws(" ", given("title"), given("organization")).alias("context"))
    return work.unionByName(projects.select(id_col, F.lit("project_bullet").alias("origin"), "item", F.coalesce("name", F.lit("")).alias("context")))


def described(summary: DataFrame, experience: DataFrame, projects: DataFrame, skills: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document as one text for a judge: summary, experience, projects and skills, those that it has.

    ``summary``: id, ``text``; ``experience``: id, ``item``, ``title``,
    ``organization``, ``bullets``; ``projects``: id, ``item``, ``name``,
    ``bullets``; ``skills``: id, ``ord``, ``raw``. A part of a document is one
    array; parts are joined by id. Null names and titles count as missing.
    """
    given = lambda c: F.when(F.col(c) != "", F.col(c))

    def listed(items: DataFrame, name: str, head: Column, empty: str) -> DataFrame:
        lines = F.concat(F.array(F.when(head != "", head).otherwise(empty)), F.transform(F.coalesce("bullets", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)))
        ordered = F.sort_array(F.collect_list(F.struct("item", F.array_join(lines, "\n").alias("text"))))
        return items.groupBy(id_col).agg(F.concat_ws("\n", F.lit(name), F.transform(ordered, lambda x: x["text"])).alias(name))

    parts = [
        summary.where("text <> ''").groupBy(id_col).agg(F.concat(F.lit("SUMMARY\n"), F.min("text")).alias("SUMMARY")),
        listed(experience, "EXPERIENCE", F.concat_ws(" — ", given("title"), given("organization")), "(role)"),
        listed(projects, "PROJECTS", F.coalesce("name", F.lit("")), "(project)"),
        skills.groupBy(id_col).agg(F.concat(F.lit("SKILLS\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"]), ", ")).alias("SKILLS")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, id_col, "full")
    return out.select(id_col, F.concat_ws("\n", "SUMMARY", "EXPERIENCE", "PROJECTS", "SKILLS").alias("text"))


def judge_prompt(bullets: DataFrame, id_col: str = "doc_id", limit: int | None = PROMPT_LIMITS["bullets"]) -> DataFrame:
    """A document's bullets as one text for a judge, in order, cut at ``limit`` characters (a limit of the model's input) unless that is None."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: F.concat(F.lit("- "), b["text"]))
    text = F.array_join(lines, "\n")
    return bullets.groupBy(id_col).agg((text if limit is None else F.left(text, F.lit(limit))).alias("prompt"))


def tagged_prompt(text: Column, tag: str, rules: str, limit: int | None = None, facts: Column | None = None) -> Column:
    """Rules, facts if any, and the text between tags, cut at ``limit`` characters unless that is None."""
    body = text if limit is None else F.left(text, F.lit(limit))
    return F.concat_ws("\n", F.lit(rules), *([] if facts is None else [facts]), F.concat(F.lit(f"<{tag}>\n"), F.coalesce(body, F.lit("")), F.lit(f"\n</{tag}>")))


def structure_prompt(text: Column, kinds: Column, rules: str) -> Column:
    """For reading a document's structure; ``kinds``: the sections found, an array."""
    known = F.array_join(F.array_sort(F.array_distinct(F.coalesce(kinds, F.array().cast("array<string>")))), ", ")
    return tagged_prompt(text, "resume", rules, PROMPT_LIMITS["resume"], F.concat(F.lit("Sections found: "), F.when(known != "", known).otherwise("none")))


def posting_prompt(text: Column, rules: str) -> Column:
    """For reading a posting's requirements."""
    return tagged_prompt(text, "job", rules, PROMPT_LIMITS["posting"])


def rubric_prompt(text: Column, rules: str) -> Column:
    """For judging a document as ``described``."""
    return tagged_prompt(text, "resume", rules, PROMPT_LIMITS["bullets"])


def verdict_prompts(pairs: DataFrame, rules: str, by: Sequence[str] = ("pair_id",)) -> DataFrame:
    """For verdicts on numbered requirements, one prompt a group. ``pairs``: keys, ``ord``, ``text``, ``evidence`` (null if nothing is similar)."""
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("ord")))
    line = F.format_string("%d. Requirement: %s\n   Evidence: %s", "n", "text", F.coalesce("evidence", F.lit("(nothing similar found)")))
    return _numbered(ranked, line, "pairs", rules, by, "\n\n")


def rewrite_prompts(weak: DataFrame, rules: str, by: Sequence[str] = ("doc_id",), correction: str | None = None) -> DataFrame:
    """For rewrites of numbered weak bullets, one prompt a group. ``weak``: keys, ``rank``, ``text``, ``reasons``; ids aren't sent. ``correction``: a column with what was wrong before."""
    ranked = weak.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))
    line = F.format_string("%d. %s\n   problems: %s", "n", "text", F.array_join("reasons", "; "))
    out = _numbered(ranked, line, "bullets", rules, by, "\n", *([correction] if correction else []))
    if not correction:
        return out
    wrong = F.concat(F.lit("\n\nNot in the original: "), F.col(correction))
    return out.withColumn("prompt", F.concat("prompt", F.coalesce(wrong, F.lit("")))).drop(correction)


def _numbered(ranked: DataFrame, line: Column, tag: str, rules: str, by: Sequence[str], between: str, *more: str) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return ranked.groupBy(*by).agg(tagged_prompt(F.array_join(lines, between), tag, rules).alias("prompt"), *[F.max(c).alias(c) for c in more])


def first_notes(notes: Column, limit: int = 3) -> Column:
    """The first ``limit`` notes that aren't blank, trimmed."""
    return F.slice(F.filter(F.transform(notes, lambda n: F.trim(n)), lambda n: n != ""), 1, limit)


def attach_rewrites(weak: DataFrame, answers: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Weak bullets (keys, ``rank``, other columns) with the answer of the same number; in the order of the selection, whatever order answers come in.

    ``answers``: keys, ``index`` (from 1), ``suggestion``, ``reasons``; the last
    of a number counts, by ``ord``. Bullets without an answer stay out. The first
    two reasons are kept; ``place`` is the order.
    """
    last = answers.groupBy(*by, "index").agg(F.max_by(F.struct("suggestion", "reasons"), "ord").alias("__a"))
    numbered = weak.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))
    out = numbered.join(last, [*by, "index"])
    return out.withColumn("suggestion", F.trim("__a.suggestion")).withColumn("reasons", first_notes(F.col("__a.reasons"), 2)).withColumnRenamed("index", "place").drop("__a")


def ungrounded(rewrites: DataFrame, originals: DataFrame, by: Sequence[str], taxonomy: DataFrame | None = None, attempt: str = "attempt") -> DataFrame:
    """Facts of each rewrite that neither its original nor its context has: ``rewrites`` with sorted ``violations``.

    Facts are numbers, skills by canonical name (with ``taxonomy``; an
    abbreviation spelt out is no new fact) and proper nouns. Words that a skill is
    written with are no proper nouns. ``rewrites``: keys, ``attempt``,
    ``suggestion``; ``originals``: keys, ``original``, ``context``.
    """
    rows = rewrites.join(originals, list(by)).withColumn("context", F.coalesce("context", F.lit("")))
    none = F.array().cast("array<string>")
    if taxonomy is None:
        rows = rows.withColumns({f"__{c}": none for c in ("new", "old", "used")})
    else:
        sides = {"suggestion": "new", "original": "old", "context": "old"}
        texts = None
        for c, side in sides.items():
            part = rows.select(F.struct(*by, attempt).alias("__key"), F.lit(side).alias("__side"), F.col(c).alias("__text")).withColumn("__row", F.struct("__key", "__side", F.lit(c).alias("c")))
            texts = part if texts is None else texts.unionByName(part)
        found = matching.mentions(texts, taxonomy, "__row", "__text").join(texts.select("__row", F.filter(F.split(T.normalise(F.col("__text")), " "), lambda w: w != "").alias("__ws")), "__row")
        words = F.flatten(F.array_distinct(F.collect_list(F.concat(F.slice("__ws", F.col("pos") + 1, F.col("n")), F.split(F.replace(F.lower("canonical"), F.lit("."), F.lit(" ")), " ")))))
        of = found.groupBy(F.col("__row.__key").alias("__key")).agg(F.collect_set(F.when(F.col("__row.__side") == "new", F.col("canonical"))).alias("__new"), F.collect_set(F.when(F.col("__row.__side") == "old", F.col("canonical"))).alias("__old"), words.alias("__used"))
        rows = rows.withColumn("__key", F.struct(*by, attempt)).join(of, "__key", "left").drop("__key").withColumns({f"__{c}": F.coalesce(f"__{c}", none) for c in ("new", "old", "used")})
    numbers = T.ungrounded_numbers(F.col("suggestion"), F.col("original"), F.col("context"))
    names = lambda c: F.array_except(T.proper_nouns(F.col(c)), F.col("__used"))
    people = F.array_except(names("suggestion"), F.array_union(names("original"), names("context")))
    people = F.filter(people, lambda n: ~F.contains(F.lower(F.concat_ws(" ", "original", "context")), n))
    violations = F.array_sort(F.concat(numbers, F.array_except("__new", "__old"), people))
    return rows.withColumn("violations", violations).drop("__new", "__old", "__used")


def accept_grounded(rewrites: DataFrame, originals: DataFrame, by: Sequence[str], attempt: str = "attempt", taxonomy: DataFrame | None = None) -> DataFrame:
    """The first attempt of each rewrite without ``ungrounded`` facts. First attempts that pass stay whatever becomes of later ones."""
    good = ungrounded(rewrites, originals, by, taxonomy, attempt).where(F.size("violations") == 0).drop("violations")
    return good.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(attempt))).where("__n = 1").drop("__n")


def progress(stage: Column) -> Column:
    """Percentage of a stage."""
    of = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return F.try_element_at(of, stage)


def monotone(events: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Events with ``percent``, never less than before in their run."""
    seen = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("percent", F.max(progress(F.col("stage"))).over(seen))


def timings(stages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Milliseconds of every stage as a map, their sum, and whether any was degraded."""
    return stages.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "ms")))).alias("timings"), F.sum("ms").alias("total_ms"), F.bool_or(F.col("status") == "degraded").alias("degraded"))

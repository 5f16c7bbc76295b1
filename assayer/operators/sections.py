"""Headings and sections of texts, contact details, and how far a parse can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import lexicon
from assayer.functions import scores as S
from assayer.functions import text as T

#: Weight of each sign of a heading, and the score that makes one.
SIGNS = {"lexicon": 2.5, "larger": 2.0, "bold": 1.0, "caps": 1.0, "short": 0.75, "open_end": 0.5, "gap": 0.75, "content": 0.5}
THRESHOLD = 3.0
CONFIDENCE = {"text_density": 0.15, "section_detection": 0.30, "contact_completeness": 0.15, "span_verification": 0.25, "content_present": 0.15}


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of texts: id, ``line`` (from 0), ``text``, ``start`` offset."""
    parts = F.split(text_col, "\n", -1)
    rows = docs.select(F.col(id_col), F.posexplode(parts).alias("line", "text"))
    order = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("long"))


def scored_lines(lines: DataFrame, id_col: str = "doc_id", larger: Column | None = None, bold: Column | None = None) -> DataFrame:
    """Non-blank lines with ``kind`` (of section, if the wording names one) and ``score`` as a heading.

    A short label with a colon and text behind it is none: score 0.
    """
    s, order = F.trim("text"), Window.partitionBy(id_col).orderBy("line")
    label = F.substring_index(s, ":", 1)
    labelled = F.contains(s, F.lit(":")) & (F.length(F.trim(F.expr("substring(trim(text), instr(trim(text), ':') + 1)"))) > 3) & (F.size(F.filter(F.split(label, r"\s+"), lambda w: w != "")) <= 3)
    count = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    shown = lines.withColumn("__some", F.trim("text") != "")
    out = shown.withColumn("__gap", F.coalesce(~F.lag("__some").over(order), F.lit(False))).withColumn("__next", F.coalesce(F.max("__some").over(order.rowsBetween(1, 2)), F.lit(False)))
    out = out.where("__some").withColumn("kind", T.section_kind(s))
    signs = {"lexicon": F.col("kind").isNotNull(), "larger": F.lit(False) if larger is None else larger, "bold": F.lit(False) if bold is None else bold, "caps": (F.upper(s) == s) & (F.lower(s) != s), "short": (count <= 6) & (F.length(s) <= 45), "open_end": ~s.rlike("[.!?,;:]$"), "gap": F.col("__gap"), "content": F.col("__next")}
    total = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in ((signs[k], w) for k, w in SIGNS.items())), F.lit(0.0))
    return out.withColumn("score", F.when(labelled, 0.0).otherwise(total)).drop("__some", "__gap", "__next")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections of each text: id, ``ord``, ``kind``, ``heading``, ``start``, ``end``, ``confidence``.

    What stands above the first heading whose wording is known is the contact
    block; without any known wording, only strong headings count.
    """
    heads = scored_lines(text_lines(docs, id_col, text_col), id_col).where(F.col("score") >= THRESHOLD)
    whole = Window.partitionBy(id_col)
    first = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(whole)
    kept = heads.withColumn("__first", first).where(F.when(F.col("__first").isNotNull(), F.col("start") >= F.col("__first")).otherwise(F.col("score") >= THRESHOLD + 1))
    sized = docs.select(F.col(id_col), F.length(text_col).alias("__length"), F.col(text_col).alias("__text")).where(F.trim("__text") != "")
    order = whole.orderBy("start")
    bounded = kept.join(sized.select(id_col, "__length"), id_col).withColumn("end", F.coalesce(F.lead("start").over(order), F.col("__length")).cast("long"))
    confidence = F.when(F.col("kind").isNotNull(), F.least(F.lit(1.0), F.col("score") / 6)).otherwise(F.least(F.lit(0.6), F.col("score") / 8))
    named = bounded.select(id_col, F.coalesce("kind", F.lit("other")).alias("kind"), F.trim("text").alias("heading"), F.least(F.col("start") + F.length("text") + 1, F.col("end")).cast("long").alias("start"), "end", F.bround(confidence, 2).alias("confidence"))
    cut = kept.groupBy(id_col).agg(F.min("start").alias("__cut"))
    top = sized.join(cut, id_col, "left").withColumn("end", F.coalesce("__cut", "__length").cast("long")).where((F.col("end") > 0) & (F.trim(F.expr("left(__text, cast(end as int))")) != ""))
    contact = top.select(id_col, F.lit("contact").alias("kind"), F.lit(None).cast("string").alias("heading"), F.lit(0).cast("long").alias("start"), "end", F.when(F.col("__cut").isNotNull(), 0.9).otherwise(0.5).alias("confidence"))
    return contact.unionByName(named).withColumn("ord", (F.row_number().over(whole.orderBy("start", "end")) - 1).cast("int"))


#: What a skill found in a section of each kind is evidence of.
ORIGIN_OF = {"experience": "experience_bullet", "projects": "project_bullet", "skills": "skills_list", "summary": "summary", "education": "education", "certifications": "certification"}


def origins(found: DataFrame, sections_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``found`` (id, ``offset``) with the ``origin`` that the section around the offset gives; ``other`` outside of all.

    A join by document on the section's range; of overlapping sections the first by ``ord`` counts.
    """
    ranges = sections_.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "kind"))).alias("__ranges"))
    around = F.get(F.filter("__ranges", lambda r: (r["start"] <= F.col("offset")) & (F.col("offset") < r["end"])), F.lit(0))["kind"]
    return found.join(ranges, id_col, "left").withColumn("origin", S.lookup(around, ORIGIN_OF, "other")).drop("__ranges")


def under_headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of postings with the latest ``heading`` above them and the ``priority`` that it gives: id, ``line``, ``text``, ``heading``, ``priority``.

    Headings themselves and blank lines are left out; a heading that names no
    priority ends the inheritance of the one before.
    """
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text"))
    up_to = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    is_head = T.is_heading_like(F.col("text"))
    marked = lines.withColumn("heading", F.last(F.when(is_head, F.trim("text")), ignorenulls=True).over(up_to))
    return marked.where(~is_head & (F.trim("text") != "")).withColumn("priority", T.priority_from_heading(F.col("heading")))


def contact(text: Column) -> Column:
    """``struct<name, email, phone, location, links>`` from the top of a text."""
    found = F.split(text, "\n", -1)
    head = F.array_join(F.slice(found, 1, 10), "\n")
    plain = lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", "")

    def is_name(line: Column) -> Column:
        s = F.trim(line)
        return (F.length(s) > 3) & (F.length(s) <= 50) & ~s.rlike(r"[\d@|]") & ~F.exists(F.split(s, r"\s+"), lambda w: plain(w).isin(*lexicon.NOT_A_NAME)) & s.rlike(r"^[A-Z][a-zA-Z.'’-]+(?:\s+[A-Z][a-zA-Z.'’-]+){0,3}$")

    null = lambda c: F.when(c != "", c)
    phone = F.trim(F.regexp_extract(head, r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,5}[\s.-])\d{2,4}[\s.-]?\d{2,6}(?![\w.])", 0))
    digits = F.length(F.regexp_replace(phone, r"\D", ""))
    url = r"(?i)\b(?:https?://|www\.)[^\s<>\"')\]]+|\b(?:linkedin\.com|github\.com|gitlab\.com|behance\.net|dribbble\.com|medium\.com)/[^\s<>\"')\]]+"
    places = F.regexp_extract_all(F.array_join(F.slice(found, 1, 8), "\n"), F.lit(r"\b([A-Z][a-z]{2,}(?:[ ][A-Z][a-z]{2,})?),[ ]*([A-Z][a-z]{2,}(?:[ ][A-Z][a-z]{2,})?)\b"), F.lit(0))
    place = F.filter(places, lambda p: ~F.exists(F.split(F.replace(p, F.lit(","), F.lit(" ")), r"\s+"), lambda w: F.lower(w).isin(*lexicon.NOT_A_NAME)))
    return F.struct(
        F.trim(F.get(F.filter(F.slice(found, 1, 8), is_name), F.lit(0))).alias("name"),
        null(F.regexp_extract(text, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0)).alias("email"),
        F.when((phone != "") & digits.between(10, 15), phone).alias("phone"),
        F.get(place, F.lit(0)).alias("location"),
        F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(url), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;)]+$", ""))).alias("links"),
    )


def completeness(c: Column) -> Column:
    """Share of name, e-mail, phone and links that a contact has."""
    return (c["name"].isNotNull().cast("int") + c["email"].isNotNull().cast("int") + c["phone"].isNotNull().cast("int") + (F.size(c["links"]) > 0).cast("int")) / 4.0


def confidence(parts: dict[str, Column], weights: dict[str, float] = CONFIDENCE) -> tuple[Column, Column]:
    """Weighted sum of the parts, 0 to 1, and the name of the smallest, the first among equals."""
    total = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    ranked = F.array(*[F.struct(parts[k].cast("double").alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(weights)])
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3), F.array_min(ranked)["k"]


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of postings: cut at blank lines and before heading-like lines. id, ``block`` (from 0), ``heading`` (whether it begins with one), ``text``."""
    chunks = docs.select(F.col(id_col), F.posexplode(F.split(F.trim(text_col), r"\n\s*\n")).alias("chunk", "ctext"))
    rows = chunks.select(id_col, "chunk", F.posexplode(F.split("ctext", "\n", -1)).alias("line", "text"))
    order = Window.partitionBy(id_col, "chunk").orderBy("line")
    opens = (T.is_heading_like(F.col("text")) & (F.col("line") > 0)).cast("int")
    parts = rows.withColumn("part", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = parts.groupBy(id_col, "chunk", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")).where(F.trim("text") != "")
    first = F.split(F.trim("text"), "\n")[0]
    return out.withColumn("block", F.row_number().over(Window.partitionBy(id_col).orderBy("chunk", "part")) - 1).select(id_col, "block", T.is_heading_like(first).alias("heading"), first.alias("first"), "text")


def clean_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, thin: int = 600) -> DataFrame:
    """Postings without boilerplate: id, ``text``, ``removed`` (blocks), ``is_thin``, ``reject`` (null or ``too_short``).

    A boilerplate heading drops what follows up to the next heading. If hardly
    anything is left, the posting stays whole.
    """
    order = Window.partitionBy(id_col).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("heading"), T.is_boilerplate_heading(F.col("first"))), ignorenulls=True).over(order)
    marked = blocks(docs, id_col, text_col).withColumn("gone", F.coalesce(state, F.lit(False)) | T.is_boilerplate_block(F.col("text")))
    kept = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("block", "text")))), lambda x: x["text"]), "\n\n")
    made = marked.groupBy(id_col).agg(F.trim(kept).alias("__kept"), F.sum(F.col("gone").cast("int")).alias("__removed"))
    raw = F.trim(text_col)
    out = docs.select(F.col(id_col), raw.alias("__raw")).join(made, id_col, "left")
    eaten = F.length(F.coalesce("__kept", F.lit(""))) < least // 2
    return out.select(id_col, F.when(eaten, F.col("__raw")).otherwise(F.col("__kept")).alias("text"), F.when(eaten, 0).otherwise(F.col("__removed")).cast("long").alias("removed"), (F.length("__raw") < thin).alias("is_thin"), F.when(F.coalesce(F.length("__raw"), F.lit(0)) < least, "too_short").alias("reject"))

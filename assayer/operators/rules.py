"""Document checks as one list of rules over one wide row: a single scan, however many rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check: it fires where ``when`` holds; a null counts as no."""

    rule_id: str
    severity: str
    deduction: float
    when: str


#: Names, severities and deductions; in order of reporting.
#: Columns: see ``layout.signals`` and ``resume_row``.
RULES = [
    Rule("multi_column", "critical", 15, "multi_column_pages > 0"),
    Rule("text_in_table", "major", 12, "has_table"),
    Rule("text_as_image", "critical", 25, "has_large_image"),
    Rule("content_in_header_footer", "major", 10, "has_margin_text"),
    Rule("informative_graphics", "minor", 5, "NOT has_large_image AND images >= 3"),
    Rule("no_standard_sections", "critical", 12, "size(array_except(kinds, array('other', 'contact'))) = 0"),
    Rule("missing_experience", "major", 8, "NOT arrays_overlap(kinds, array('experience', 'projects'))"),
    Rule("missing_education", "major", 8, "NOT array_contains(kinds, 'education')"),
    Rule("missing_email", "critical", 10, "email IS NULL"),
    Rule("missing_phone", "minor", 10, "phone IS NULL"),
    Rule("unparseable_dates", "major", 6, "dates >= 2 AND dates_parsed / dates < 0.6"),
    Rule("exotic_fonts", "minor", 5, "size(unusual_fonts) > 0"),
    Rule("excessive_length", "minor", 8, "pages > 2 AND months < 60"),
    Rule("hidden_text", "critical", 20, "hidden_spans > 0"),
    Rule("unprofessional_filename", "minor", 2, "NOT professional_filename"),
]
#: Tokens of careless file names.
CARELESS = ("final", "copy", "new", "updated", "untitled", "document", "asdf", "(1)", "v2")


def professional_filename(filename: Column) -> Column:
    """Whether no careless token is in the name without extension; no name is fine."""
    stem = F.lower(F.when(F.contains(filename, F.lit(".")), F.regexp_replace(filename, r"\.[^.]*$", "")).otherwise(filename))
    hit = F.exists(F.array(*map(F.lit, CARELESS)), lambda t: F.contains(stem, t))
    return F.when(filename.isNull() | (filename == ""), True).otherwise(~hit)


def findings(rows: DataFrame, by: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """A row for each rule that fires: keys, ``ord``, ``rule_id``, ``severity``, ``deduction``. Rules are a parameter: the registry is a list."""
    fired = [F.when(F.coalesce(F.expr(r.when), F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(float(r.deduction)).alias("deduction"))) for i, r in enumerate(rules)]
    return rows.select(*by, F.explode(F.array_compact(F.array(*fired))).alias("f")).select(*by, "f.ord", "f.rule_id", "f.severity", "f.deduction")


def is_encrypted(content: Column, tail: int = 2048) -> Column:
    """Whether the last ``tail`` bytes of a file name an encryption dictionary."""
    return F.contains(F.substring(content, F.greatest(F.octet_length(content) - (tail - 1), F.lit(1)), F.lit(tail)), F.lit(b"/Encrypt"))


def posting_quality(text: Column, least: int = 200, thin: int = 600) -> Column:
    """``short``, ``thin`` or ``ok``, by characters without blanks at the ends; null is short."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n < least, "short").when(n < thin, "thin").otherwise("ok")


def posting_warning(text: Column) -> Column:
    """What to tell about a posting before it is read, or null: too short, little to go on, or no word of requirements."""
    quality = posting_quality(text)
    asks = F.lower(text).rlike("requirement|qualification|experience|skill|must have|you have|you will|responsibilit")
    return F.when(quality == "short", "too short to read").when(~asks, "names no requirements").when(quality == "thin", "little to go on")


def gate(rows: DataFrame, max_bytes: int = 8 << 20, max_pages: int = 10) -> DataFrame:
    """Files with ``reject``: why a file is refused, the first reason in order; null if it passes.

    ``rows``: ``content`` (binary) and, where they are known, ``encrypted``,
    ``pages``, ``chars``, ``has_covering_image``, ``english_ratio``.
    """
    has = set(rows.columns)
    checks = [("empty", F.coalesce(F.octet_length("content"), F.lit(0)) == 0), ("too_large", F.octet_length("content") > max_bytes), ("not_pdf", F.substring("content", 1, 5) != F.lit(b"%PDF-"))]
    # a reader may know it; else the trailer tells
    checks.append(("encrypted", F.col("encrypted") if "encrypted" in has else is_encrypted(F.col("content"))))
    if "pages" in has:
        checks += [("no_pages", F.col("pages") == 0), ("too_many_pages", F.col("pages") > max_pages)]
    if {"chars", "pages", "has_covering_image"} <= has:
        checks += [("scanned", (F.try_divide("chars", "pages") < 25) & F.col("has_covering_image")), ("no_text", F.col("chars") == 0)]
    if "english_ratio" in has:
        checks.append(("not_english", F.col("english_ratio") < 0.06))
    out = None
    for code, hit in checks:
        hit = F.coalesce(hit, F.lit(False))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return rows.withColumn("reject", out)

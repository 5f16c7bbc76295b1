"""Dates as people write them, months and windows of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months and seasons, and words for "still".
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sept": 9, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
SEASONS = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
PRESENT = ("present", "current", "now", "ongoing", "date", "today")


def _year(digits: Column) -> Column:
    """Two digits are of this century up to 50, else of the last."""
    n = digits.try_cast("int")
    return F.when(n >= 100, n).when(n < 50, n + 2000).otherwise(n + 1900)


def _named(name: Column, values: dict[str, int]) -> Column:
    return F.get(F.array(*map(F.lit, values.values())), (F.array_position(F.array(*map(F.lit, values)), name) - 1).cast("int"))


def parse_point(text: Column) -> Column:
    """``struct<year, month, present>`` of one date: words for now, day-month-year, month name, season, month/year, year-month, year, short year; the first form found counts."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"^[.,;]+|[.,;]+$", "")
    grab = lambda pattern, g: F.regexp_extract(t, pattern, g)
    dmy, my, ym = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b", r"\b(\d{1,2})[/\-.](\d{4})\b", r"\b(\d{4})[/\-.](\d{1,2})\b"
    month = r"\b(" + "|".join(MONTHS) + r")\.?\s*,?\s*'?(\d{2,4})\b"
    season = r"\b(" + "|".join(SEASONS) + r")\s*'?(\d{2,4})\b"
    point = lambda y, m: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), F.lit(False).alias("present"))
    none, number = F.lit(None).cast("int"), lambda p, g: grab(p, g).try_cast("int")
    now = F.exists(F.split(t, r"\s+"), lambda w: w.isin(*PRESENT))
    return (
        F.when(t.isNull() | (t == ""), F.struct(none.alias("year"), none.alias("month"), F.lit(False).alias("present")))
        .when(now, F.struct(none.alias("year"), none.alias("month"), F.lit(True).alias("present")))
        .when(t.rlike(dmy), point(number(dmy, 3), number(dmy, 2)))
        .when(t.rlike(month), point(_year(grab(month, 2)), _named(grab(month, 1), MONTHS)))
        .when(t.rlike(season), point(_year(grab(season, 2)), _named(grab(season, 1), SEASONS)))
        .when(t.rlike(my) & number(my, 1).between(1, 12), point(number(my, 2), number(my, 1)))
        .when(t.rlike(ym) & number(ym, 2).between(1, 12), point(number(ym, 1), number(ym, 2)))
        .when(t.rlike(r"\b'?(\d{4})\b"), point(number(r"\b'?(\d{4})\b", 1), none))
        .when(t.rlike(r"'(\d{2})\b"), point(_year(grab(r"'(\d{2})\b", 1)), none))
        .otherwise(F.struct(none.alias("year"), none.alias("month"), F.lit(False).alias("present")))
    )


def parse_range(text: Column, compat: bool = False) -> Column:
    """``struct<start_year, start_month, end_year, end_month, is_current, raw>`` of a period.

    The first dash or word for "to" splits it. ``compat`` splits at such a word
    anywhere and at any dash, as in ``2024-01``; otherwise words stand alone and
    a dash between digits needs blanks.
    """
    raw = F.trim(text)
    cut = r"(?i)\s*(?:-|–|—|to|until|through|thru)\s*" if compat else r"(?i)\s*[–—]\s*|\s+-\s*|\s*-\s+|(?<=\D)-(?=\D)|\s*\b(?:to|until|through|thru)\b\s*"
    parts = F.split(raw, cut, 2)
    first, second = parse_point(F.get(parts, F.lit(0))), parse_point(F.get(parts, F.lit(1)))
    single, two = parse_point(raw), (F.size(parts) == 2) & (F.trim(F.get(parts, F.lit(1))) != "")
    turned = first["present"] & ~second["present"]
    make = lambda a, b, current: F.struct(a["year"].alias("start_year"), a["month"].alias("start_month"), F.when(~current, b["year"]).alias("end_year"), F.when(~current, b["month"]).alias("end_month"), current.alias("is_current"), raw.alias("raw"))
    none = F.lit(None).cast("int")
    ended = F.struct(second["year"].alias("start_year"), second["month"].alias("start_month"), none.alias("end_year"), none.alias("end_month"), F.lit(False).alias("is_current"), raw.alias("raw"))
    return F.when(two & turned, ended).when(two, make(first, second, second["present"])).otherwise(make(single, single, single["present"]))


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def months_between(start_year: Column, start_month: Column, end_year: Column, end_month: Column, is_current: Column, as_of: Column) -> Column:
    """Months of a period: a missing first month is January, a missing last one December, a current period ends at ``as_of``; never below 0."""
    end = F.when(is_current, month_index(F.year(as_of), F.month(as_of))).otherwise(month_index(end_year, F.coalesce(end_month, F.lit(12))))
    return F.greatest(F.lit(0), end - month_index(start_year, F.coalesce(start_month, F.lit(1))))


def utc(text: Column) -> Column:
    """An ISO time as a timestamp: with ``Z`` or an offset as it says, without as UTC, whatever the session's zone; null if it is none."""
    said = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(said, text).otherwise(F.concat(text, F.lit("Z"))))


def expiry(now: Column, days: Column) -> Column:
    """``now`` and 1 to 30 days, 7 if none are given."""
    return now + F.make_dt_interval(F.greatest(F.lit(1), F.least(F.lit(30), F.coalesce(days, F.lit(7)))))

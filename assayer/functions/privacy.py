"""Redaction, scrubbing and hashing expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What identifies a person, in the order it is looked for.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"')\]]+|\b(?:linkedin\.com|github\.com|gitlab\.com|behance\.net|dribbble\.com)/[^\s<>\"')\]]+"
BIRTH = r"(?i)\b(?:D\.?O\.?B\.?|Date\s+of\s+Birth|Birth\s*date)\b\s*[:\-]?\s*[\w/.,-]{4,20}"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{2,4}[\s.-]?\d{2,6}(?![\w.])"


def redact(text: Column) -> Column:
    """E-mail addresses, links, birth dates and phone numbers as ``[EMAIL]``, ``[URL]``, ``[DOB]``, ``[PHONE]``."""
    out = text
    for pattern, mark in ((EMAIL, "[EMAIL]"), (URL, "[URL]"), (BIRTH, "[DOB]"), (PHONE, "[PHONE]")):
        out = F.regexp_replace(out, pattern, mark)
    return out


def scrub(text: Column, secrets: Column, mark: str = "[redacted]") -> Column:
    """``text`` without any of the strings in ``secrets``, longest first, whatever their case; those of word characters only as whole words."""
    ordered = F.array_sort(F.array_distinct(F.filter(secrets, lambda s: s.isNotNull() & (F.trim(s) != ""))), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def one(t: Column, s: Column) -> Column:
        edge = F.when(s.rlike(r"^\w.*\w$|^\w$"), r"\b").otherwise("")
        return F.regexp_replace(t, F.concat(F.lit(r"(?iu)"), edge, F.lit(r"\Q"), s, F.lit(r"\E"), edge), F.lit(mark))

    return F.aggregate(ordered, text, one)


def identifying(name: Column, email: Column, phone: Column, links: Column, employers: Column, institutions: Column) -> Column:
    """All strings that identify a person: names of three letters up, the local part of an address of four, links of four."""
    parts = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda p: F.length(p) > 2)
    local = F.filter(F.array(F.substring_index(email, "@", 1)), lambda p: F.length(p) > 3)
    some = F.array_compact(F.array(name, email, phone))
    extra = F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.length(x) > 3)
    out = F.concat(employers, institutions, some, parts, local, extra)
    return F.array_distinct(F.filter(out, lambda s: s.isNotNull() & (F.trim(s) != "")))


def scrub_log(key: Column, value: Column, content_keys: Iterable[str] = ("text", "prompt", "resume", "jd", "content", "body"), secret_keys: Iterable[str] = ("token", "password", "secret", "api_key", "authorization")) -> Column:
    """A log value: contents become their length and hash, secrets a mark, addresses and long numbers in others are masked."""
    plain = F.regexp_replace(F.regexp_replace(value, EMAIL, "<email>"), r"\d{7,}", "<number>")
    return F.when(F.lower(key).isin(*secret_keys), "<secret>").when(F.lower(key).isin(*content_keys), fingerprint(value)).otherwise(plain)


def fingerprint(value: Column) -> Column:
    """Length and the first eight digits of the SHA-256 of a text."""
    return F.concat(F.lit("<"), F.length(value).cast("string"), F.lit(" chars sha:"), F.left(F.sha2(value.cast("binary"), 256), F.lit(8)), F.lit(">"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("binary"), F.lit(b"\0"))]), 256)


def embedding_key(text: Column) -> Column:
    """The first 32 digits of the SHA-256 of the trimmed text in lower case."""
    return F.left(F.sha2(F.lower(F.trim(text)).cast("binary"), 256), F.lit(32))

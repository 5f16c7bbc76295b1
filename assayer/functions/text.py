"""Text expressions. Each takes and returns Columns; a null text gives null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer import lexicon

MARKERS = "•\\-–— "
#: What may stand around a needle that its text hasn't.
AROUND = " \t•-–—*·.,;:"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once, however often ``use`` names it; inside a lambda a bare expression is worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def alternation(phrases: Iterable[str]) -> str:
    """A pattern of quoted phrases, longest first."""
    return "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether the lower-cased text contains one of ``phrases``."""
    return bound(F.lower(text), lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in phrases]))


def phrases_in(text: Column, phrases: Iterable[str]) -> Column:
    """Those of ``phrases`` that the lower-cased text contains, in their order."""
    return bound(F.lower(text), lambda t: F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p)))


def words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return _all(text, "[A-Za-z']+")


def first_word(text: Column) -> Column:
    """The first word after bullet marks, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.trim(text), f"^[{MARKERS}]+", ""), "[A-Za-z']+", 0))


def has_number(text: Column) -> Column:
    """Whether the text counts something: a run of digits other than a bare year."""
    runs = F.transform(_all(text, r"\d[\d,.]*"), lambda x: F.regexp_replace(x, "[.,]+$", ""))
    return F.exists(runs, lambda x: ~x.rlike(r"^(19|20)\d{2}$"))


def opens_with(text: Column, verbs: Iterable[str] = lexicon.ACTION_VERBS) -> Column:
    """Whether the first word is one of ``verbs``."""
    return first_word(text).isin(*verbs)


def weak_phrases(text: Column, phrases: Iterable[str] = lexicon.WEAK_PHRASES) -> Column:
    return phrases_in(text, phrases)


def is_passive(text: Column) -> Column:
    return text.rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(?:was|were|been|being|is|are|be)\s+[\p{L}\p{N}_]+(?:ed|en)(?:$|[^\p{L}\p{N}_])")


def is_first_person(text: Column) -> Column:
    return text.rlike(r"(?:^|[^\p{L}\p{N}_])(?:I|me|my|mine|myself)(?:$|[^\p{L}\p{N}_])")


def english_ratio(text: Column, markers: Iterable[str] = lexicon.ENGLISH_MARKERS, least_words: int = 20) -> Column:
    """Share of the ASCII words that are common English ones; 1 if there are too few words to tell."""
    found = _all(F.lower(text), "[a-z]+")
    known = F.size(F.filter(found, lambda w: w.isin(*markers)))
    return F.when(F.size(found) < least_words, 1.0).otherwise(known / F.size(found))


def normalise(text: Column) -> Column:
    """Lower case; what is no word character, white space, ``+``, ``#`` or ``.`` is a blank; blanks collapse."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s+#.]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def token_sort(text: Column) -> Column:
    """Words in ascending order."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda x: x != "")), " ")


def collapse_whitespace(text: Column) -> Column:
    """Blanks within a line collapse to one, those at line ends go, three line breaks or more become two."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0B]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def join_hyphenated(text: Column) -> Column:
    """Words that a line break cut at a hyphen."""
    return F.regexp_replace(text, r"([A-Za-z]{2,})-\n([a-z]{2,})", "$1$2")


def canonical_bullets(text: Column) -> Column:
    """One bullet mark for all at the beginning of lines."""
    return F.regexp_replace(text, r"(?m)^([ \t]*)[•·‣⁃▪▫◦●○■□–—*-](?=[ \t])", "$1•")


def repair_spaced_caps(text: Column) -> Column:
    """Headings written with a blank after each capital."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"^\s*(?:[A-Z] ){2,}[A-Z]\s*$"), F.replace(x, F.lit(" "), F.lit(""))).otherwise(x))
    return F.array_join(lines, "\n")


def normalise_layout(text: Column) -> Column:
    """Fixed characters, bullets, hyphenation, spaced capitals and white space in turn."""
    plain = F.translate(text, " ’‘“”−‐‑", " ''\"\"---")
    return collapse_whitespace(repair_spaced_caps(join_hyphenated(canonical_bullets(plain))))


def strip_quotes(text: Column) -> Column:
    """Quoted runs of ten characters or more give way to an ellipsis."""
    return F.regexp_replace(text, "[\"“][^\"“”]{10,}[\"”]", "…")


def mention_count(text: Column, needle: Column) -> Column:
    """Occurrences of ``needle`` that don't overlap, without case; one at least."""
    t, n = F.lower(text), F.lower(needle)
    found = (F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.greatest(F.length(n), F.lit(1))
    return F.greatest(F.lit(1), found.cast("int"))


def heading_key(text: Column) -> Column:
    """Letters and single blanks only, lower-cased."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z\\s]", " "), r"\s+", " "))


def section_key(text: Column) -> Column:
    """As ``heading_key``, but digits stay and apostrophes vanish."""
    plain = F.regexp_replace(F.lower(text), "['’‘]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9\\s]+", " "), r"\s+", " "))


def section_kind(text: Column, headings: dict[str, tuple[str, ...]] = lexicon.HEADINGS) -> Column:
    """The section that a heading names: the exact phrase, else, in four words at most, the longest phrase of five letters up that it contains."""
    kinds = {p: kind for kind, phrases in headings.items() for p in phrases}
    longest = sorted(kinds, key=lambda p: -len(p))
    of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    padded = F.array(*[F.lit(f" {p} ") for p in longest if len(p) >= 5])

    def kind(key: Column) -> Column:
        inside = bound(F.concat(F.lit(" "), key, F.lit(" ")), lambda k: F.get(F.filter(padded, lambda p: F.contains(k, p)), F.lit(0)))
        return F.when(key == "", None).otherwise(F.coalesce(F.try_element_at(of, key), F.when(F.size(F.split(key, " ")) <= 4, F.try_element_at(of, F.trim(inside)))))

    return bound(section_key(text), kind)


def is_heading_like(line: Column) -> Column:
    """Whether a line of a posting looks like a heading."""
    s = F.trim(line)
    shaped = s.rlike(r"^[^a-z]{0,4}([A-Za-z][A-Za-z\s/&'-]{2,45})[:\s]*$") | ((F.upper(s) == s) & (F.lower(s) != s))
    return (F.length(s) > 2) & (F.length(s) <= 50) & ~s.rlike("[.!?]$") & shaped


def is_boilerplate_heading(line: Column) -> Column:
    return heading_key(line).rlike("^(?:" + alternation(lexicon.BOILERPLATE_HEADINGS) + ")")


def is_boilerplate_block(block: Column) -> Column:
    """One telling phrase, or three words of benefits."""
    return contains_any(block, lexicon.BOILERPLATE_PHRASES) | (F.size(phrases_in(block, lexicon.BENEFIT_WORDS)) >= 3)


def is_negated(text: Column) -> Column:
    return contains_any(text, lexicon.NEGATIONS)


def priority_from_text(text: Column) -> Column:
    """``strong``, ``nice`` or ``must`` by wording, looked for in this order; else null."""
    return F.when(contains_any(text, lexicon.STRONG_CUES), "strong").when(contains_any(text, lexicon.NICE_CUES), "nice").when(contains_any(text, lexicon.MUST_CUES), "must")


#: Priorities that headings give what stands under them.
HEADING_PRIORITY = {
    "strong": ("strongly preferred", "highly desirable"),
    "must": ("required", "requirements", "minimum requirements", "must have", "essential", "essential criteria", "what you need", "qualifications", "minimum qualifications", "key requirements", "required qualifications", "required skills"),
    "nice": ("preferred", "preferred qualifications", "nice to have", "nice-to-have", "desirable", "desired", "bonus", "a plus", "good to have", "pluses", "extras", "optional"),
}


def priority_from_heading(heading: Column) -> Column:
    """The priority of the longest phrase that the heading contains; else null."""
    key, out = heading_key(heading), None
    pairs = [(p, priority) for priority, phrases in HEADING_PRIORITY.items() for p in phrases]
    for phrase, priority in sorted(pairs, key=lambda p: -len(p[0])):
        out = F.when(F.contains(key, F.lit(phrase)), priority) if out is None else out.when(F.contains(key, F.lit(phrase)), priority)
    return out


def resolve_priority(proposed: Column, text: Column, heading: Column, in_title: Column, mentions: Column) -> Column:
    """Negation, job title, wording, heading, repetition, proposal: the first that speaks decides."""
    raised = F.when(proposed == "nice", "strong").when(proposed == "strong", "must").otherwise(proposed)
    return F.when(is_negated(text), "nice").when(in_title, "must").otherwise(F.coalesce(priority_from_text(text), priority_from_heading(heading), F.when(mentions >= 3, raised).otherwise(proposed)))


def quantifier_years(text: Column) -> Column:
    """Years that a requirement asks for, in digits (the first of a range) or words; else null."""
    digits = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*\+?\s*(?:-\s*\d+\s*)?(?:or\s+more\s+)?year", 1)
    names = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    word = F.lower(F.regexp_extract(text, rf"(?i)\b({'|'.join(names)})\s*\+?\s*year", 1))
    number = F.array_position(F.array(*map(F.lit, names)), word)
    return F.when(digits != "", digits.cast("double")).when(number > 0, number.cast("double"))


def number_facts(text: Column) -> Column:
    """Numbers that the text claims, in one form each: thousands separators gone, k, m and b multiplied out, ``%`` kept."""
    pattern = r"(\d[\d,]*(?:\.\d+)?)\s*([kKmMbB])?(%)?"

    def fact(found: Column) -> Column:
        value = F.replace(F.regexp_extract(found, r"^[\d,.]+", 0), F.lit(","), F.lit("")).try_cast("double")
        unit = F.lower(F.regexp_extract(found, r"([kKmMbB])%?$", 1))
        scaled = value * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
        return F.concat(six_digits(scaled), F.when(found.endswith("%"), "%").otherwise(""))

    return F.array_sort(F.array_distinct(F.transform(_all(text, pattern), fact)))


def six_digits(value: Column) -> Column:
    """A number at six significant digits without trailing zeros, as ``%g`` writes it (plain below a million)."""
    digits = F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-300)))).cast("int")
    rounded = F.when(value == 0, 0.0).otherwise(F.round(value * F.pow(F.lit(10.0), 5 - digits)) / F.pow(F.lit(10.0), 5 - digits))
    exponent = F.floor(F.log10(F.greatest(F.abs(rounded), F.lit(1e-300)))).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", rounded / F.pow(F.lit(10.0), exponent)), "0+$", ""), r"\.$", "")
    return F.when((value == 0) | ((exponent >= -4) & (exponent < 6)), plain).otherwise(F.concat(mantissa, F.format_string("e%+03d", exponent)))


def ungrounded_numbers(claim: Column, source: Column, context: Column) -> Column:
    """Numbers of ``claim`` that neither ``source`` nor ``context`` has."""
    return F.array_except(number_facts(claim), F.array_union(number_facts(source), number_facts(context)))


def proper_nouns(text: Column, common: Iterable[str] = ()) -> Column:
    """Capitalised words of three letters or more inside sentences, lower-cased, distinct and sorted."""
    inside = F.regexp_replace(text, r"(^|[.!?]\s+)[A-Z][a-zA-Z]*", "$1")
    found = F.transform(_all(inside, r"\b([A-Z][a-zA-Z]{2,})\b", 1), F.lower)
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(*common) if common else F.lit(True))))


def injection_markers(text: Column) -> Column:
    """Wordings that try to steer a model, distinct and sorted."""
    pattern = (
        r"(?i)(ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions|disregard\s+(?:the\s+)?(?:above|previous)|you\s+are\s+now\s+|system\s*(?:prompt|message)\s*:"
        r"|rate\s+this\s+(?:resume\s+)?\d+\s*(?:/|out\s+of)\s*\d+|(?:score|give)\s+(?:this|me)\s+(?:a\s+)?(?:100|10/10|perfect)|as\s+an\s+ai\s+(?:language\s+)?model)"
    )
    return F.array_sort(F.array_distinct(F.transform(_all(text, pattern), lambda x: F.trim(x))))


def line_at(text: Column, offset: Column) -> Column:
    """Number of the line, from 0, that the character at ``offset`` (from 0) lies in."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1)) - 1


def span_holds(source: Column, start: Column, end: Column, text: Column) -> Column:
    """Whether ``source`` from ``start`` to ``end`` (from 0, exclusive) is ``text``."""
    ok = (start >= 0) & (end > start) & (end <= F.length(source)) & (F.substring(source, start + 1, end - start) == text)
    return F.coalesce(ok, F.lit(False))


def locate(source: Column, needle: Column) -> Column:
    """Where the needle begins (from 0): as it is, without bullets, blanks and stops around it, or with any white space between its words; else null. For many needles a text see ``locating``."""
    bare = F.btrim(needle, F.lit(AROUND))
    exact, trimmed = F.instr(source, needle), F.instr(source, bare)
    quoted = F.regexp_replace(bare, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    loose = F.concat(F.lit("(?s)^(.*?)"), F.regexp_replace(quoted, r"\s+", r"\\s+"))
    before = F.call_function("regexp_extract", source, loose, F.lit(1))
    found = F.call_function("regexp_like", source, loose)
    return F.when(needle == "", None).when(exact > 0, exact - 1).when(bare == "", None).when(trimmed > 0, trimmed - 1).when(found, F.length(before))


def starts(lengths: Column, chunk: int = 256) -> Column:
    """Where each of the parts with these lengths begins: the sum of all before it, by chunks, so that no long array is copied for each of its values. ``lengths`` should be a column of its own: an expression is computed for each chunk."""
    grow = lambda values, first: F.aggregate(values, F.array(first), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int")), lambda c: F.slice(lengths, c * chunk + 1, chunk))
    before = grow(F.transform(chunks, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)), F.lit(0))
    return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda x, b: F.slice(grow(x, b), F.lit(1), F.size(x))))

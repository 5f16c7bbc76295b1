"""Personal data: base patterns, high-recall candidates, boosted trees over their format and context.

Base patterns (e-mail, IP address, card, phone number) are found for certain. Beside
them, generators propose whatever looks like personal data in other dress (addresses
with ``(at)``, numbers with other separators or without a plus), overlapping as they
come. Boosted trees score each candidate by its format and by what stands beside it;
they learn from base spans, from the same spans written in other forms, from spoilt
ones, and from candidates that touch no base span, which count as not personal.
Thresholds by kind are set on spans that the trees haven't seen, forms against spoilt
ones; as some free candidates are personal, those can't be held against a threshold,
but it is never below even odds. Candidates above them are added, unless they
touch a base span; of candidates that touch one another the likeliest is taken.

Everything is DataFrame functions, so nothing leaves the JVM. Texts are read once
and spans are written from a job without a shuffle; later steps shuffle spans, never
texts, keyed by row, so a group is a text's own spans. Patterns can't run away on
long texts: repetitions are bounded or possessive, and a token is tried from its
beginning only.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.shared import bounded_batches, keep

KINDS = ["email", "ip", "card", "phone"]
#: What a kind's base spans (each in several forms) and free candidates weigh in all at most, one each up to there; all of them count, however many.
FIT_BASE, FIT_FREE = 250, 700
#: Different feature vectors that one task fits on.
FIT_ROWS = 100_000
#: Trees, their depth, the share of right ones among the calibration spans that a threshold must reach, and the least threshold.
TREES, DEPTH, PRECISION, EVEN = 12, 4, 0.99, 0.5
#: Characters of context.
LEFT, RIGHT = 24, 8
#: Matches whose lengths are summed in one array.
CHUNK = 256

_LOCAL = r"[A-Za-z0-9._%+-]"
#: The patterns of the contract, written so that a token is tried from its beginning or from the end of the match before.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20{0,2}(?:@|[\[({<]\x20?(?:at|@)\x20?[\])}>]|\x20at\x20)\x20{0,2}", r"\x20{0,2}(?:\.|[\[({<]\x20?(?:dot|\.)\x20?[\])}>]|\x20dot\x20)\x20{0,2}"
GENERATORS = {
    "email": [rf"(?i)(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}+{_AT}[\p{{L}}\p{{N}}-]{{1,63}}+(?:{_DOT}[\p{{L}}\p{{N}}-]{{1,63}}+){{1,8}}+"],
    "ip": [r"(?<![0-9])[0-9]{1,3}+(?:(?:\x20?\.\x20?|\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}+){3}"],
    "card": [r"[0-9](?:[\x20.\-_/]{0,2}[0-9]){12,18}+"],
    "phone": [r"(?:\+|(?<![0-9])00)?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,14}+", r"\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.\-]?[0-9]{3,4}"],
}
#: What a text must hold before a pattern is tried on it.
_HINT = {"email": r"(?i)@|\bat\b", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_SPANS = "array<struct<kind: string, base: boolean, start: int, end: int, match: string, left: string, right: string>>"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CUES = {"email": "e-?mail|mail|contact|write to|reach", "ip": "ip|host|server|address|from", "card": "card|visa|amex|payment|credit", "phone": "phone|tel|call|fax|mobile|cell"}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass Luhn's test."""
    back = F.rpad(F.reverse(digits), 19, "0")
    values = [F.ascii(F.substring(back, i + 1, 1)) - 48 for i in range(19)]
    terms = [v * 2 - F.when(v > 4, 9).otherwise(0) if i % 2 else v for i, v in enumerate(values)]
    return reduce(add, terms) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(match))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _starts(lengths: Column) -> Column:
    """Sums of all values before each one, by chunks, so that no long array is copied for each of its values."""
    grow = lambda values, first: F.aggregate(values, F.array(first), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))
    before = grow(F.transform(chunks, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)), F.lit(0))
    return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda x, b: F.slice(grow(x, b), F.lit(1), F.size(x))))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and candidates of every text, and one row without a kind for a text that has none.

    Columns ``row`` (of the text), ``id``, ``kind``, ``base``, ``start``, ``end`` (code
    points, end exclusive), ``match``, ``left`` and ``right`` (up to the next match).
    """
    rules = [(k, True, BASE[k]) for k in KINDS] + [(k, False, g) for k in KINDS for g in GENERATORS[k]]
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none, hints = F.array().cast("array<string>"), [F.col("text").rlike(h).alias(f"hint_{k}") for k, h in _HINT.items()]
    rows = rows.select("*", *hints)
    found = [F.when(F.col(f"hint_{k}"), F.regexp_extract_all(text, F.lit(r), F.lit(0))).otherwise(none).alias(f"found{i}") for i, (k, _, r) in enumerate(rules)]
    gaps = [F.when(F.col(f"hint_{k}"), F.split(text, r, -1)).otherwise(none).alias(f"gaps{i}") for i, (k, _, r) in enumerate(rules)]
    rows = rows.select("row", "id", *found, *gaps)
    # both arrays are named more than once, so that the optimizer doesn't move the patterns into the lambdas
    lengths = [F.when(F.size(f"found{i}") > 0, _starts_of(i)).alias(f"starts{i}") for i in range(len(rules))]
    rows = rows.select("*", *lengths)
    lists = [_listed(i, kind, base) for i, (kind, base, _) in enumerate(rules)]
    return rows.select("row", "id", F.explode_outer(F.concat(*lists)).alias("s")).select("row", "id", "s.*")


def _listed(i: int, kind: str, base: bool) -> Column:
    """The matches of rule ``i`` as spans; of a base pattern those that count."""

    def span(n: Column) -> Column:
        match, start = F.element_at(f"found{i}", n), F.element_at(f"starts{i}", n)
        return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), F.right(F.element_at(f"gaps{i}", n), F.lit(LEFT)).alias("left"), F.left(F.element_at(f"gaps{i}", n + 1), F.lit(RIGHT)).alias("right"))

    every = F.when(F.size(f"found{i}") > 0, F.transform(F.sequence(F.lit(1), F.size(f"found{i}")), span))
    return F.coalesce(F.filter(every, lambda s: passes(kind, s["match"])) if base else every, F.array().cast(_SPANS))


def _starts_of(i: int) -> Column:
    """Where each match of rule ``i`` begins: behind all gaps and matches before it and its own gap."""
    both = F.zip_with(F.slice(f"gaps{i}", F.lit(1), F.size(f"found{i}")), f"found{i}", lambda g, m: F.length(g) + F.length(m))
    return F.zip_with(_starts(both), F.slice(f"gaps{i}", F.lit(1), F.size(f"found{i}")), lambda before, g: before + F.length(g))


def free_of_base(found: DataFrame) -> DataFrame:
    """Adds ``free``: whether a span touches no base span of its text."""
    by_start = Window.partitionBy("row").orderBy("start", F.desc("base"))
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return found.withColumn("free", ~F.coalesce(ends > F.col("start"), F.lit(False)) & ~F.coalesce(begins < F.col("end"), F.lit(False)))


def features() -> dict[str, Column]:
    """Format of ``match``, and what stands in ``left`` and ``right``; the kind that is asked about is one of them."""
    m, left, right = F.col("match"), F.col("left"), F.col("right")
    groups = F.filter(F.split(m, "[^0-9]+", -1), lambda g: g != "")
    marks = F.regexp_replace(m, r"[\p{L}\p{N}]", "")
    count = lambda pattern: F.length(F.regexp_replace(m, pattern, ""))
    out = {f"is_{k}": F.col("kind") == k for k in KINDS}
    out |= {"chars": F.length(m), "digits": F.length(_digits(m)), "letters": count(r"[^\p{L}]"), "marks": F.length(marks), "kinds_of_marks": F.size(F.array_distinct(F.split(marks, ""))), "dots": count("[^.]"), "blanks": count(r"[^\x20]"), "brackets": count(r"[^\[\](){}<>]"), "at": count("[^@]")}
    out |= {"groups": F.size(groups), "first_group": F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), "last_group": F.length(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit(""))), "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "largest_part": F.coalesce(F.array_max(F.transform(groups, lambda g: F.left(g, F.lit(6)).cast("int"))), F.lit(0))}
    out |= {"luhn": luhn(F.left(_digits(m), F.lit(19))), "plus": m.startswith("+"), "zeros": m.startswith("00"), "last_label": F.length(F.regexp_extract(m, r"(\p{L}+)[^\p{L}]*$", 1)), "capital_label": m.rlike(r"[\x20.]\p{Lu}\p{Ll}*[^\p{L}]*$")}
    out |= {"left_word": left.rlike(r"[\p{L}\p{N}]$"), "left_number": left.rlike(r"[0-9][\x20.,:/-]?$"), "left_mark": left.rlike(r"""[=#"'$_]\x20?$"""), "right_word": right.rlike(r"^[\p{L}\p{N}_]"), "right_number": right.rlike(r"^[\x20.,:/-]?[0-9]"), "no_left": left == "", "no_right": right == ""}
    out |= {f"cue_{k}": left.rlike(rf"(?i)\b(?:{words})[^\p{{L}}\p{{N}}]{{0,3}}$") for k, words in _CUES.items()}
    return {name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in out.items()}


def _forms() -> Column:
    """Other forms of a base span as (match, label): dressed differently, still personal (1), or spoilt (0)."""
    m, d = F.col("match"), _digits(F.col("match"))
    swap = lambda c, *pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    fours = lambda sep: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    kinds = {
        "email": ([m, swap(m, ("@", " (at) ")), swap(m, ("@", "[at]"), (".", "[dot]")), swap(m, ("@", " at "), (".", " dot ")), swap(m, ("@", " @ ")), F.upper(m)], [swap(m, ("@", " at ")), swap(m, ("@", " at "), (".", ". "))]),
        "ip": ([m, swap(m, (".", "[.]")), swap(m, (".", "(.)")), swap(m, (".", " dot "))], [F.concat(F.lit("9"), m), F.regexp_replace(m, r"\.[0-9]+$", ".999"), swap(m, (".", " . "))]),
        "card": ([m, fours(" "), fours("."), fours("-"), fours("/")], [F.concat(F.expr("left(match, length(match) - 1)"), ((F.right(m, F.lit(1)).cast("int") + 1) % 10).cast("string"))]),
        "phone": ([m, F.regexp_replace(m, r"^\+", "00"), F.regexp_replace(m, r"^\+", ""), swap(m, ("-", ".")), swap(m, ("-", "/")), F.regexp_replace(m, r"^\+[0-9]+[\x20-]*(?=\()", "")], [d, F.left(d, F.lit(8)), F.regexp_replace(d, "([0-9]{3})(?=[0-9])", "$1 ")]),
    }
    out = F.array().cast("array<struct<match: string, label: double>>")
    for kind, (good, bad) in kinds.items():
        pattern = "|".join(f"(?:{g})" for g in GENERATORS[kind])
        forms = F.array(*[F.struct(x.alias("match"), F.lit(y).alias("label")) for y, xs in ((1.0, good), (0.0, bad)) for x in xs])
        out = F.when(F.col("kind") == kind, _whole(forms, pattern)).otherwise(out)
    return out


def _whole(forms: Column, pattern: str) -> Column:
    """The forms that ``pattern`` matches as a whole, so that a generator can propose them."""
    return F.filter(forms, lambda f: f["match"].rlike(f"^(?:{pattern})$"))


def examples(found: DataFrame) -> DataFrame:
    """Labelled spans, from every base span and every free candidate: ``kind``, ``match``, ``left``, ``right``, ``label``, ``free``, ``weight``.

    Equal ones count once, so that a span that is copied a million times is one
    example. Base spans of a kind weigh ``FIT_BASE`` at most in all, free ones
    ``FIT_FREE``, so the balance doesn't change with the size of a corpus.
    """
    picked = found.where(F.col("kind").isNotNull() & (F.col("base") | F.col("free"))).select("kind", "base", "match", "left", "right").distinct()
    n = picked.groupBy("kind", "base").agg(F.count("*").alias("n"))
    picked = picked.join(F.broadcast(n), ["kind", "base"]).withColumn("weight", F.least(F.lit(1.0), F.when(F.col("base"), FIT_BASE).otherwise(FIT_FREE) / F.col("n")))
    good = picked.where("base").select("kind", F.explode(_forms()).alias("f"), "left", "right", "weight").select("kind", "f.match", "left", "right", "f.label", F.lit(False).alias("free"), "weight")
    return good.unionByName(picked.where("not base").select("kind", "match", "left", "right", F.lit(0.0).alias("label"), F.lit(True).alias("free"), "weight"))


def assembled(rows: DataFrame) -> DataFrame:
    named = features()
    return VectorAssembler(inputCols=list(named), outputCol="features").transform(rows.withColumns(named))


def train(found: DataFrame, least: int = 20) -> tuple[GBTClassificationModel | None, DataFrame]:
    """Trees, and the ``threshold`` of each kind that has one. Kinds and corpora with too few examples get none."""
    rows = keep(examples(found).withColumn("part", F.pmod(F.xxhash64("match", "left"), F.lit(4))), "pii-examples")
    counts = {r["label"]: r["n"] for r in rows.where("part > 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    no = found.sparkSession.createDataFrame([], "kind string, threshold double")
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < least:
        return None, no
    # equal vectors are one row with their weight: far fewer than spans, in one order, so that the trees are the same each time
    names = list(features())
    fit = keep(rows.where("part > 0").withColumns(features()).groupBy("label", *names).agg(F.sum("weight").alias("weight")), "pii-vectors")
    tasks = -(-fit.count() // FIT_ROWS)
    fit = (fit.coalesce(1) if tasks == 1 else fit.repartitionByRange(tasks, *names, "label")).sortWithinPartitions(*names, "label")
    fit = VectorAssembler(inputCols=names, outputCol="features").transform(fit).select("features", "label", "weight")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, stepSize=0.3, weightCol="weight").fit(fit)
    seen = score(rows.where("part = 0 and not free"), model).groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    by_p, every = Window.partitionBy("kind").orderBy(F.desc("p")), Window.partitionBy("kind")
    right = seen.select("kind", "p", (F.sum("good").over(by_p) / F.sum("n").over(by_p)).alias("right"), F.sum("n").over(every).alias("n"))
    return model, keep(right.where((F.col("right") >= PRECISION) & (F.col("n") >= least)).groupBy("kind").agg(F.greatest(F.min("p"), F.lit(EVEN)).alias("threshold")), "pii-thresholds")


def score(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """Adds ``p``, the trees' probability."""
    return model.transform(assembled(rows)).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def chosen(found: DataFrame, model: GBTClassificationModel | None, thresholds: DataFrame) -> DataFrame:
    """Base spans, and the added ones: ``row``, ``kind``, ``base``, ``start``, ``end``, ``p`` (null for base spans)."""
    columns = ["row", "kind", "base", "start", "end"]
    base = found.where("base").select(*columns, F.lit(None).cast("double").alias("p"))
    if model is None:
        return base
    likely = score(found.where("not base and free"), model).join(F.broadcast(thresholds), "kind").where("p >= threshold")
    by_start = Window.partitionBy("row").orderBy("start", "end", "kind")
    ends = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start") < ends, 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = F.row_number().over(Window.partitionBy("row", "group").orderBy(F.desc("p"), F.desc(F.col("end") - F.col("start")), "start", "kind"))
    return base.unionByName(likely.withColumn("group", group).withColumn("best", best).where("best = 1").select(*columns, "p"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans`` of every row, by start and then by kind: array of (``start``, ``kind_no``, ``end``, ``base``, ``p``).

    ``kind_no`` is the kind's place in ``KINDS``. A null text counts as empty and has
    none; equal rows and null ids stay rows of their own; other columns aren't read,
    whatever their names; a text of any length is read whole; an empty table gives an
    empty result. Without enough examples only base spans are found.
    """
    bounded_batches(docs.sparkSession)
    found = keep(spans(docs, id_col, text_col), "pii-spans")
    told = keep(free_of_base(found.where("kind is not null")), "pii-told")
    model, thresholds = train(told)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    every = chosen(told, model, thresholds).select("row", F.struct("start", number.alias("kind_no"), "end", "base", "p").alias("span"))
    texts = found.groupBy("row").agg(F.first("id").alias("id"))
    return texts.join(every.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans")), "row", "left").select("id", F.coalesce("spans", F.array().cast("array<struct<start: int, kind_no: int, end: int, base: boolean, p: double>>")).alias("spans"))


def redact(text: Column, spans_: Column) -> Column:
    """``text`` with ``<kind>`` in place of each of its spans that doesn't begin inside an earlier one."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind_no"] + 1)).alias("out"), s["end"].alias("at")))
    done = F.aggregate(spans_, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))

"""How bullets are written: seven metrics, proofreading flags, the weakest ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import lexicon
from assayer.functions import text as T

IDEAL = (8, 30)
METRICS = ["quantification", "action_verbs", "bullet_length", "weak_phrases", "passive_voice", "first_person", "opener_variety"]


def bullets_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank lines of texts as bullets: id, ``ord`` (from 0, blank lines counted), ``text``."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("ord", "text")).where(F.trim("text") != "")


def _judged(t: Column) -> dict[str, Column]:
    """What the metrics count of one bullet."""
    return {
        "quantification": T.has_number(t),
        "action_verbs": T.opens_with(t),
        "bullet_length": F.size(T.words(t)).between(*IDEAL),
        "weak_phrases": F.size(T.weak_phrases(t)) > 0,
        "passive_voice": T.is_passive(t),
        "first_person": T.is_first_person(t),
    }


def metrics(bullets: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a group with the share of bullets that count something, open with a verb, and so on."""
    marked = bullets.withColumn("opener", T.first_word(F.col("text")))
    flags = marked.groupBy(*by).agg(F.count("*").alias("bullets"), *[F.avg(c.cast("int")).alias(k) for k, c in _judged(F.col("text")).items()])
    openers = marked.where("opener <> ''").groupBy(*by, "opener").count().groupBy(*by).agg((1.0 - F.sum((F.col("count") > 2).cast("int")) / F.count("*")).alias("opener_variety"))
    return flags.join(openers, list(by), "left").withColumn("opener_variety", F.coalesce("opener_variety", F.lit(1.0)))


def bullet_array(text: Column) -> Column:
    """Non-blank lines of a text with their numbers, as ``bullets_of`` gives them, but within its row."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("ord"), x.alias("text")))
    return F.filter(numbered, lambda b: F.trim(b["text"]) != "")


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``metrics`` of each text's lines, computed within its row: no line leaves it, nothing is shuffled."""
    facts = F.transform(bullet_array(F.col(text_col)), lambda b: F.struct(*[c.alias(k) for k, c in _judged(b["text"]).items()], T.first_word(b["text"]).alias("opener")))
    some = F.col(text_col).rlike(r"[^ \n]")  # a line that isn't blank; cheaper than a condition on the facts, which would be computed twice
    rows = docs.where(some).select(F.col(id_col), facts.alias("__facts"))
    n, names = F.size("__facts"), list(_judged(F.lit("")))
    share = lambda k: F.size(F.filter("__facts", lambda f: f[k])) / n
    openers = F.sort_array(F.filter(F.transform("__facts", lambda f: f["opener"]), lambda o: o != ""))
    rows = rows.select(id_col, n.cast("long").alias("bullets"), *[share(k).alias(k) for k in names], openers.alias("__openers"))
    # an opener used three times or more begins where the next but one equals it and the one before doesn't
    at = F.filter(F.sequence(F.lit(0), F.size("__openers") - 3), lambda i: (F.get("__openers", i) == F.get("__openers", i + 2)) & ((i == 0) | (F.get("__openers", i - 1) != F.get("__openers", i))))
    worn = F.when(F.size("__openers") < 3, 0).otherwise(F.size(at))
    variety = F.coalesce(1.0 - F.try_divide(worn, F.size(F.array_distinct("__openers"))), F.lit(1.0))
    return rows.select(id_col, "bullets", *names, variety.alias("opener_variety"))


def long_metrics(wide: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The metrics as rows of ``key`` and ``value``."""
    return wide.select(*by, *[F.col(k).cast("double").alias(k) for k in METRICS]).unpivot(list(by), METRICS, "key", "value")


def metric_array(wide: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The rows of ``long_metrics`` as one array ``metrics`` a group, by ``key``, within its row."""
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in sorted(METRICS)]
    return wide.select(*by, F.array(*pairs).alias("metrics"))


def offenders(bullets: DataFrame, failing, by: Sequence[str] = ("doc_id",), limit: int = 5) -> DataFrame:
    """The first ``limit`` bullets of each group for which ``failing`` holds, in order."""
    first = Window.partitionBy(*by).orderBy("ord")
    return bullets.where(failing).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)


def _weakness(t: Column) -> Column:
    """Faults of a trimmed bullet: padding, no result, no verb, too short or long (words by white space here)."""
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.when(F.size(T.weak_phrases(t)) > 0, 1.5).otherwise(0.0) + F.when(~T.has_number(t), 1.5).otherwise(0.0) + F.when(~T.opens_with(t), 1.0).otherwise(0.0) + F.when(n < IDEAL[0], 1.0).when(n > IDEAL[1], 0.75).otherwise(0.0)


def weakest(bullets: DataFrame, by: Sequence[str] = ("doc_id",), limit: int = 5, least: float = 2.0) -> DataFrame:
    """The ``limit`` weakest bullets of each group, worst first, then in order."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "ord")
    scored = bullets.withColumn("score", _weakness(F.trim("text"))).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def weakest_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 5, least: float = 2.0) -> DataFrame:
    """``weakest`` of each text's lines, within its row: id, ``ord``, ``text``, ``score``, ``rank``."""
    scored = F.transform(bullet_array(F.col(text_col)), lambda b: F.struct((-_weakness(F.trim(b["text"]))).alias("less"), b["ord"].alias("ord"), b["text"].alias("text")))
    best = F.slice(F.sort_array(F.filter(scored, lambda b: b["less"] <= -least)), 1, limit)
    rows = docs.select(F.col(id_col), F.posexplode(best).alias("pos", "b"))
    return rows.select(id_col, "b.ord", "b.text", (-F.col("b.less")).alias("score"), (F.col("pos") + 1).alias("rank"))


def flags(bullets: DataFrame, by: Sequence[str] = ("doc_id",), severities: Sequence[str] = ("error", "polish")) -> DataFrame:
    """Proofreading flags: keys, ``ord``, ``kind``, ``severity``, ``found``. One scan; lists of findings explode once. Only kinds of ``severities`` are looked for."""
    t = F.col("text")
    bare = lambda w: F.btrim(w, F.lit(".'"))
    tokens = F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z.']*"), F.lit(0)), bare)
    wrong = F.filter(tokens, lambda w: F.lower(w).isin(*lexicon.MISSPELLINGS))
    official = {x.lower(): x for x in lexicon.TECHNOLOGY_CASING}
    apart = F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z/@:\\_-])([A-Za-z][A-Za-z.']*)(?![/@:\\_\d-])"), F.lit(1))
    cased = F.filter(F.transform(apart, bare), lambda w: F.lower(w).isin(*official) & ~w.isin(*official.values()))
    doubled = F.filter(F.regexp_extract_all(t, F.lit(r"(?i)\b([A-Za-z]{2,})\s+\1\b"), F.lit(1)), lambda w: ~F.lower(w).isin("had", "that", "no", "very", "so"))
    first = F.regexp_extract(F.regexp_replace(t, f"^[{T.MARKERS}]+", ""), "[A-Za-z][A-Za-z.']*", 0)
    lower_start = first.rlike("^[a-z]") & ~F.lower(first).isin(*official)
    brackets = F.length(F.replace(t, F.lit("("), F.lit(""))) != F.length(F.replace(t, F.lit(")"), F.lit("")))
    some = lambda cond, found: F.when(cond, F.array(found)).otherwise(F.array().cast("array<string>"))
    kinds = [
        ("misspelling", "error", wrong),
        ("technology_casing", "polish", cased),
        ("doubled_word", "error", doubled),
        ("space_before_punctuation", "error", F.regexp_extract_all(t, F.lit(r"[ \t]+[,;:.!?]"), F.lit(0))),
        ("missing_space", "error", F.regexp_extract_all(t, F.lit("[,;][A-Za-z]"), F.lit(0))),
        ("repeated_punctuation", "polish", F.regexp_extract_all(t, F.lit(r"([!?,;:])\1+|(?<!\.)\.{2}(?!\.)"), F.lit(0))),
        ("unbalanced_brackets", "error", some(brackets, F.left(t, F.lit(40)))),
        ("lowercase_start", "polish", some(lower_start, first)),
    ]

    def labelled(kind: str, severity: str, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), x.alias("found")))

    found = F.flatten(F.array(*[labelled(*k) for k in kinds if k[1] in severities]))
    return bullets.select(*by, "ord", F.explode(found).alias("f")).select(*by, "ord", "f.kind", "f.severity", "f.found")


def report(flags_: DataFrame, by: Sequence[str] = ("doc_id",), limit: int = 12) -> DataFrame:
    """Flags of one kind and wording as one, errors first, then the frequent ones; ``limit`` a group, with the group's ``total``."""
    merged = flags_.groupBy(*by, "kind", "severity", F.lower("found").alias("found")).agg(F.count("*").alias("occurrences"), F.min("ord").alias("ord"))
    order = Window.partitionBy(*by).orderBy((F.col("severity") != "error").cast("int"), F.desc("occurrences"), "ord", "kind", "found")
    total = F.count("*").over(Window.partitionBy(*by))
    return merged.withColumn("rank", F.row_number().over(order)).withColumn("total", total).where(F.col("rank") <= limit)


def _inconsistent(counted: DataFrame, by: Sequence[str], least: int, slip: float) -> DataFrame:
    minority = F.least(F.col("stops"), F.col("n") - F.col("stops"))
    return counted.where((F.col("n") >= least) & (minority > 0) & (minority / F.col("n") <= slip)).select(*by, "n", minority.alias("minority"), (F.col("stops") > F.col("n") / 2).alias("with_stop"))


def terminators(bullets: DataFrame, by: Sequence[str] = ("doc_id",), least: int = 4, slip: float = 0.35) -> DataFrame:
    """Groups that end most bullets one way and a few the other: ``n``, ``minority``, ``with_stop`` (whether most have a full stop)."""
    return _inconsistent(bullets.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.rtrim("text").endswith(".").cast("int")).alias("stops")), by, least, slip)


def text_terminators(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 4, slip: float = 0.35) -> DataFrame:
    """``terminators`` of each text's lines, within its row."""
    ends = F.transform(bullet_array(F.col(text_col)), lambda b: F.rtrim(b["text"]).endswith("."))
    counted = docs.select(F.col(id_col), ends.alias("__ends")).select(id_col, F.size("__ends").cast("long").alias("n"), F.size(F.filter("__ends", lambda e: e)).cast("long").alias("stops"))
    return _inconsistent(counted, [id_col], least, slip)

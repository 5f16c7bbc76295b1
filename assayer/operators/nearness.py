"""Strings that are nearly equal: a q-gram prefix join, then the exact ratio.

Similarity is 200 x the longest common subsequence over the sum of lengths, of
strings whose words are sorted. Two strings of lengths that sum to S and that
share a subsequence of length L share at least 3L - 1 - S of their bigrams (a
bigram that occurs again counts as another), since each character that isn't
shared spoils two at most on its own side and one on the other. So of each
string, only its rarest bigrams, as many as it may lose and one more, need to meet:
an equi-join on bigrams gives all candidates and few others, however many strings
there are. Only distinct strings are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assayer.functions import text as T

FUZZY_LEAST = 82.0
#: Lengths whose bound is worked out exactly.
SHORT = 64


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table as the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the ``ratio`` of the first two columns, strings whose words are sorted."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([200.0 * common_subsequence(s, t) / (len(s) + len(t)) for s, t in pairs], pa.float64())], names=[*batch.schema.names, "ratio"])


def least_shared(length: int, least: float) -> int:
    """Fewest bigrams that a string of ``length`` shares with any string at ``least`` similarity; 0 or less where bigrams can't tell."""
    most = 0
    for other in range(1, int(length * (200 / least)) + 2):
        both = length + other
        common = -int(-least * both // 200)
        if common <= min(length, other):
            shared = 3 * common - 1 - both
            most = shared if most == 0 else min(most, shared)
            if most <= 0:
                return 0
    return most


def bigrams(text: Column) -> Column:
    """Bigrams of ``text``, each with the number of times that it has occurred before."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g)).cast("string"))))


def _prefixes(strings: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """The rarest bigrams of each string, as many as a similar one can't all lack: ``s``, ``gram``."""
    table = F.array(*[F.lit(least_shared(n, least)) for n in range(SHORT + 1)])
    # for longer ones the same without rounding: both lengths sum to length x 200 / (200 - least) at the least
    slope = (3 * least / 200 - 1) * 200 / (200 - least)
    shared = F.when(F.length("s") <= SHORT, F.get(table, F.length("s"))).otherwise(F.greatest(F.lit(0), F.floor(F.length("s") * slope - 1)))
    grams = strings.select("s", F.explode(bigrams(F.col("s"))).alias("gram")).join(frequency, "gram")
    place = F.row_number().over(Window.partitionBy("s").orderBy("n", "gram"))
    needed = F.length("s") - 1 - shared + 1
    return grams.withColumn("place", place).where(F.col("place") <= needed).select("s", "gram")


def similar(left: DataFrame, right: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """Pairs of distinct strings (column ``s`` of each, words sorted) at ``least`` similarity or more: ``s``, ``t``, ``ratio``.

    Null, empty and single characters are similar to nothing but an equal string;
    equal strings are always a pair. No string meets all others: the join is on
    bigrams, rare ones first. ``least`` must be above 66.7, where two strings may
    share no bigram.
    """
    a, b = (x.where("s <> ''").select("s").distinct() for x in (left, right))
    if least <= 200 / 3:
        raise ValueError("bigrams tell nothing of similarities that low")
    # only lengths that some string of the other side allows, a little more by rounding; the exact condition follows
    ratio = (200 - least) / least
    sizes = b.select(F.length("s").alias("__m")).distinct().select(F.explode(F.sequence(F.floor(F.col("__m") / ratio).cast("int"), F.ceil(F.col("__m") * ratio).cast("int"))).alias("__n")).distinct()
    a = a.join(F.broadcast(sizes), F.length("s") == F.col("__n"), "left_semi")
    some = F.length("s") >= 2
    frequency = a.unionByName(b).where(some).select(F.explode(bigrams(F.col("s"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    first = _prefixes(a.where(some), frequency, least)
    second = _prefixes(b.where(some), frequency, least).withColumnRenamed("s", "t")
    fits = 200.0 * F.least(F.length("s"), F.length("t")) >= least * (F.length("s") + F.length("t"))
    met = first.join(second, "gram").where((F.col("s") != F.col("t")) & fits).select("s", "t").distinct()
    near = met.mapInArrow(_ratios, StructType([*met.schema.fields, StructField("ratio", DoubleType())])).where(F.col("ratio") >= least)
    equal = a.join(b, "s").select("s", F.col("s").alias("t"), F.lit(100.0).alias("ratio"))
    return near.unionByName(equal)


def best_alias(strings: DataFrame, taxonomy: DataFrame, column: str, least: float = FUZZY_LEAST) -> DataFrame:
    """For each distinct string the most similar alias: ``column``, ``canonical``, ``ratio``; of equals the shorter, then the first by ``ord``."""
    key = lambda c: T.token_sort(T.normalise(F.col(c)))
    a = strings.select(F.col(column).alias("__string"), key(column).alias("s")).where(F.col("__string").isNotNull()).distinct()
    b = taxonomy.select("canonical", "ord", F.length(T.normalise(F.col("alias"))).alias("length"), key("alias").alias("t"))
    near = a.join(similar(a, b.select(F.col("t").alias("s")), least), "s").join(b, "t")
    best = F.max_by(F.struct("canonical", "ratio"), F.struct("ratio", -F.col("length"), -F.col("ord"))).alias("best")
    return near.groupBy("__string").agg(best).select(F.col("__string").alias(column), "best.canonical", "best.ratio")


def best_skill(wanted: DataFrame, skills: DataFrame, by: Sequence[str], id_col: str = "requirement_id", least: float = FUZZY_LEAST) -> DataFrame:
    """For each wanted string the most similar skill of its own document: keys, ``id_col``, ``skill``, ``ratio``; of equals the first by ``ord``.

    ``wanted``: keys, ``id_col``, ``target``; targets of fewer than three characters
    meet nothing. ``skills``: keys, ``canonical``, ``ord``, a row a skill. Similar
    strings are found once for all documents; a document's rows meet its own skills
    only through them.
    """
    key = lambda c: T.token_sort(T.normalise(F.col(c)))
    a = wanted.where(F.length(T.normalise(F.col("target"))) >= 3).select(*by, id_col, key("target").alias("__s"))
    b = skills.select(*by, F.col("canonical").alias("__skill"), F.col("ord").alias("__ord"), key("canonical").alias("__t"))
    pairs = similar(a.select(F.col("__s").alias("s")), b.select(F.col("__t").alias("s")), least).toDF("__s", "__t", "__ratio")
    met = a.join(pairs, "__s").join(b, [*by, "__t"])
    best = F.max_by(F.struct(F.col("__skill").alias("skill"), F.col("__ratio").alias("ratio")), F.struct("__ratio", -F.col("__ord"), F.col("__skill"))).alias("__best")
    return met.groupBy(*by, id_col).agg(best).select(*by, id_col, "__best.skill", "__best.ratio")

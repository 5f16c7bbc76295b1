"""Verdicts on URLs: a blocked Bloom filter of listed canonical URLs, then an exact join.

An entry is a canonical URL, ``host/path`` without scheme, query and fragment.
It covers its host with all subdomains and every path that begins with its own.
A URL is turned into the few entries that could cover it: host suffixes with as
many labels as entries have, times path prefixes with as many characters as
entries have. The Bloom filter (one 64-bit word a block, four bits an entry)
drops nearly all of them, and a hash join with the list removes false positives.
Everything is DataFrame expressions, and each distinct URL is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The filter is broadcast up to so many 64-bit words (16 MB with their block numbers); beyond, it is joined by shuffle.
BROADCAST_WORDS = 1_000_000
ENTRIES_PER_WORD = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def entries(spark: SparkSession, rules: list[tuple[str, str]], listed: DataFrame | None = None) -> DataFrame:
    """Rules (entry, verdict) and listed URLs (column ``url``; they block) as one table. A listed URL's host is lower-cased, its path stays."""
    rows = [(e, e.partition("/")[0], "/" + e.partition("/")[2], v, True) for e, v in rules]
    out = spark.createDataFrame(rows, "entry string, e_host string, e_path string, verdict string, is_rule boolean")
    if listed is None:
        return out
    host = F.substring_index("url", "/", 1)
    entry = F.concat(F.translate(host, UPPER, LOWER), F.expr("substring(url, length(substring_index(url, '/', 1)) + 1)"))
    more = listed.where(F.col("url").isNotNull()).select(entry.alias("entry"), F.translate(host, UPPER, LOWER).alias("e_host"))
    more = more.withColumn("e_path", F.expr("substring(entry, length(e_host) + 1)")).distinct()
    return out.unionByName(more.select("*", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(63).cast("int")))
    return mask


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of ``keys``: ``block`` and the 64-bit ``word`` of each block that has a bit."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("word"))


def judge_urls(pages: DataFrame, listing: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Host, path, covering rule and verdict of every row's URL.

    ``listing`` comes from ``entries``. Rules win over listed URLs, the longest
    entry wins among each. Returns the columns of ``pages`` other than ones of
    the same names, with ``host``, ``path``, ``rule`` (null if none covers),
    ``listed`` (whether any entry covers) and ``verdict``. A null URL or one
    without ``://`` has empty host and path and gets the default; repeated rows
    stay repeated; entries of equal length can't both cover a URL with different
    hosts and be the longest, as the longer host then wins; empty tables give
    empty results. A URL of any length is read whole; it makes as many probes as
    the listing has label counts times path lengths. Columns of ``pages`` called
    ``__salt`` or ``__best`` give way.
    """
    whole = pages.select(*[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "listed", "verdict", "__salt", "__best")], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    shape = listing.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("e_host", r"\."))).alias("labels"), F.collect_set(F.length("e_path")).alias("lengths")).first()
    blocks = max(1, -(-shape["n"] // ENTRIES_PER_WORD))
    labels, lengths = F.array(*map(F.lit, sorted(shape["labels"]) or [0])), F.array(*map(F.lit, sorted(shape["lengths"]) or [0]))
    urls = whole.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    probes = urls.select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("probe"))
    words = bloom_filter(listing.select("entry"), "entry", blocks)
    if blocks <= BROADCAST_WORDS:
        words = F.broadcast(words)
    probes = probes.withColumn("block", _block(F.col("probe"), blocks)).join(words, "block")
    possible = probes.where(F.col("word").bitwiseAND(_mask(F.col("probe"))) == _mask(F.col("probe")))
    exact = possible.join(listing, F.col("probe") == F.col("entry"))
    best = F.max(F.struct("is_rule", F.length("entry").alias("n"), F.length("e_host").alias("h"), "entry", "verdict")).alias("__best")
    found = exact.groupBy("host", "path").agg(best)
    # URLs without a host have no match: they are dealt out evenly instead of meeting under one key
    salt = F.when(F.col("host") == "", F.monotonically_increasing_id() % 4096 + 1).otherwise(F.lit(0))
    out = whole.withColumn("__salt", salt).join(found.withColumn("__salt", F.lit(0).cast("long")), ["host", "path", "__salt"], "left")
    kept = [c for c in whole.columns if c not in ("host", "path")]
    rule = F.when(F.col("__best.is_rule"), F.col("__best.entry"))
    return out.select(*kept, "host", "path", rule.alias("rule"), F.col("__best").isNotNull().alias("listed"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))

"""Importance resampling towards a target distribution, by hashed n-grams over an integer word dictionary.

Texts are tokenised once, a block of texts at a time: a block holds its distinct
words, its distinct n-grams as tuples of places in that list, and for every text
the numbers of its n-grams. Only distinct words and distinct n-grams of a block
leave it. Words of all blocks become one dictionary of ids; n-grams become tuples
of ids, which are counted over corpus and target; each distinct tuple's bytes are
put together from the dictionary and hashed once; and counts of buckets give
gains, which are grouped with the blocks again, one at a time. Memory is bound by a
block (an Arrow batch), the driver sees nothing but the number of texts, and only the gains of
buckets, whose number is a parameter, are broadcast.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.shared import bounded_batches, keep

#: Buckets whose gains are broadcast at most, 16 bytes each.
MOST_BUCKETS = 1 << 20
#: A block is a row of megabytes, so a row group holds one: a writer would else gather a hundred of them, and a reader take all of a group at once.
ONE_BLOCK = {"parquet.block.row.count.limit": 1}
#: Words, on bytes whose A-Z are lower-cased: ASCII digits and letters, and all bytes of other characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLOCK = "block long, {ids}, n_words array<long>, n_features array<long>, sizes array<int>, grams array<int>, times array<int>, words array<binary>, tuples array<struct<member: array<int>, times: long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def _blocks(n: int, target: bool):
    """One row for a batch of texts: its ids, words and features a text, and each text's n-grams by number, with their counts.

    Blocks of the target have odd task numbers in their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not len(batch):
                continue
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            texts = [np.fromiter(map(number.__getitem__, words_of(t.as_py())), np.int32) for t in batch["text"]]
            found, members = _grams(texts, n, len(number))
            distinct = [np.unique(g, return_counts=True) for g in found]
            grams, times = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int32) for x in zip(*distinct))
            every = np.bincount(grams, times, minlength=len(members)).astype(np.int64)
            # a single word's tuple is its own number, which isn't written
            tuples = pa.StructArray.from_arrays([pa.array(members if n > 1 else [None] * len(members), pa.list_(pa.int32())), pa.array(every)], names=["member", "times"])
            one = lambda column, kind: pa.ListArray.from_arrays(np.array([0, len(column)], np.int32), pa.array(column, kind))
            lists = [batch["id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([len(g) for g in found], pa.int64()), pa.array([len(g) for g, _ in distinct], pa.int32()), pa.array(grams), pa.array(times), pa.array(list(number), pa.binary()), tuples]
            yield pa.RecordBatch.from_arrays([pa.array([(task * 2 + target << 32) + count], pa.int64()), *(one(x, x.type) for x in lists)], names=["block", "ids", "n_words", "n_features", "sizes", "grams", "times", "words", "tuples"])
            count += 1

    return run


def _grams(texts: list[np.ndarray], n: int, n_words: int) -> tuple[list[np.ndarray], list]:
    """Numbers of the n-grams of each text, and the words of each n-gram; n-grams of one word have the words' own numbers."""
    if n == 1:
        return texts, [None] * n_words
    number: defaultdict[tuple, int] = defaultdict()
    number.default_factory = lambda: n_words + len(number)
    found = []
    for t in texts:
        w = t.tolist()
        found.append(np.array(w + [number[tuple(w[i : i + k])] for k in range(2, n + 1) for i in range(len(w) - k + 1)], np.int64))
    return found, [[i] for i in range(n_words)] + [list(g) for g in number]


def _weights(block: pa.Table, found: pa.Table) -> pa.Table:
    """Sums of the gains of each text's features: a block with what is found for its n-grams."""
    ids, n_words, n_features, sizes, grams, times = (block[c][0].values for c in ("ids", "n_words", "n_features", "sizes", "grams", "times"))
    gain = np.zeros(len(found), np.int64)
    gain[found["gram"].to_numpy()] = found["gain"].to_numpy()
    sums = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(gain[grams.to_numpy()] * times.to_numpy(), out=sums[1:])
    ends = np.cumsum(sizes.to_numpy(), dtype=np.int64)
    weight = sums[ends] - sums[ends - sizes.to_numpy()]
    return pa.table([ids, n_words, n_features, pa.array(weight)], names=["id", "n_words", "n_features", "weight"])


def feature_blocks(texts: DataFrame, n: int, target: bool) -> DataFrame:
    """Blocks of ``texts`` (``id``, ``text`` as bytes)."""
    return texts.mapInArrow(_blocks(n, target), _BLOCK.format(ids=f"ids array<{texts.schema['id'].dataType.simpleString()}>"))


def gains(counts: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and ``gain`` of every bucket that ``counts`` (``bucket``, ``s``, ``t``) names, times 1000 and rounded down."""
    both = counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda name, more: F.col(name).cast("double") + more
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return both.join(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """Log importance weight, times 1000, of every text of ``docs`` towards the texts of ``target`` (column ``text``).

    Words are runs of ASCII letters and digits and of all other characters beyond
    ASCII, with A-Z lower-cased; features are all runs of 1 to ``n`` words, joined
    by one blank. A feature's bucket is its CRC-32 modulo ``buckets``; a bucket's
    gain compares its shares of both sides, each bucket counted once more; the
    weight sums the gains of a text's features. Returns ``id``, ``n_words``,
    ``n_features`` and ``weight`` (0 without features), all long but the id. Null
    texts have no words; equal rows and null ids stay rows of their own; other
    columns aren't read; a text of any length is one block's; an empty table gives
    an empty result, and an empty target gives gains from the corpus alone.
    """
    if not 1 <= buckets <= MOST_BUCKETS or n < 1:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}, n 1 or more")
    bounded_batches(docs.sparkSession)
    as_texts = lambda df, c: df.select(c.alias("id"), F.col(text_col if df is docs else "text").cast("binary").alias("text"))
    mine = keep(feature_blocks(as_texts(docs, F.col(id_col)), n, False), "resample-blocks", **ONE_BLOCK)
    aim = keep(feature_blocks(as_texts(target, F.lit(0)), n, True), "resample-target", **ONE_BLOCK)
    both = mine.select("block", "words", "tuples").unionByName(aim.select("block", "words", "tuples"))
    dictionary = keep(both.select(F.explode("words").alias("word")).distinct().withColumn("word_id", F.monotonically_increasing_id()), "resample-words")
    ids = [f"id{k}" for k in range(n)]
    if n == 1:  # the tuples of a block are its words, in their order
        words = both.select("block", F.posexplode(F.arrays_zip("words", "tuples.times")).alias("gram", "x"))
        tuples = words.select("block", "gram", F.col("x.times").alias("times"), F.col("x.words").alias("word")).join(dictionary, "word").select("block", "gram", "times", F.col("word_id").alias("id0"))
    else:
        known = both.select("block", F.posexplode("words").alias("place", "word")).join(dictionary, "word").select("block", "place", "word_id")
        members = both.select("block", F.posexplode("tuples").alias("gram", "x")).select("block", "gram", "x.times", F.posexplode("x.member").alias("k", "place"))
        one = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("word_id"))), F.lit(-1)).alias(f"id{k}") for k in range(n)]
        tuples = members.join(known, ["block", "place"]).groupBy("block", "gram", "times").agg(*one)
    tuples = keep(tuples, "resample-tuples")
    of_target = F.shiftright("block", 32) % 2 == 1
    counts = tuples.groupBy(*ids).agg(F.sum(F.when(of_target, 0).otherwise(F.col("times"))).alias("s"), F.sum(F.when(of_target, F.col("times")).otherwise(0)).alias("t"))
    hashed = keep(_spelled(counts, dictionary, n).select(*ids, "s", "t", (F.crc32("bytes") % buckets).cast("int").alias("bucket")), "resample-tuples-hashed")
    gain = hashed.join(F.broadcast(gains(hashed, buckets)), "bucket").select(*ids, "gain")
    back = tuples.where(~of_target).select("block", "gram", *ids).join(gain, ids).select("block", "gram", "gain")
    done = mine.select("block", "ids", "n_words", "n_features", "sizes", "grams", "times").groupBy("block").cogroup(back.groupBy("block"))
    return done.applyInArrow(_weights, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def _spelled(counts: DataFrame, dictionary: DataFrame, n: int) -> DataFrame:
    """``counts`` with the ``bytes`` of each distinct tuple: its words, joined by one blank."""
    out = counts
    for k in range(n):
        word = dictionary.select(F.col("word_id").alias(f"id{k}"), F.col("word").alias(f"word{k}"))
        out = out.join(word, f"id{k}", "left")
    more = [F.coalesce(F.concat(F.lit(b" "), F.col(f"word{k}")), F.lit(b"")) for k in range(1, n)]
    return out.select(*counts.columns, F.concat(F.col("word0"), *more).alias("bytes"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise times -1000, in doubles, from the first 32 bits of a hash of ``seed:key``."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000


def draw(weighted: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Adds ``score`` (weight and noise) and ``rank``, from 1, of the drawn ``percent`` of the texts with ``least_words`` or more.

    Highest scores are drawn, ties go to the smaller id, null last, then to the text
    with fewer features. Others have a null rank. Ranks come from a sort by range: each task
    numbers its own rows behind the counts of the tasks before, so no task holds all.
    """
    scored = keep(weighted.withColumn("score", F.col("weight") + F.floor(noise(F.col("id"), seed))), "resample-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    ranked = keep(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("pid", F.spark_partition_id()), "resample-ranks")
    counts = ranked.groupBy("pid").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    before = counts.select("pid", "from", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranked.join(F.broadcast(before), "pid").withColumn("rank", F.col("at") - F.col("from") + F.col("before") + 1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = scored.where(F.col("n_words") < least_words)
    return placed.select(*scored.columns, rank).unionByName(rest.select(*scored.columns, F.lit(None).cast("long").alias("rank")))

"""Importance resampling against a plain version, for features of one word and of several."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from assayer.llm import queries, resample
from llm_brute import SF, rows

SCHEMA = "doc_id long, text string, id string, block int, tuple string, gain double, rank int, n_words string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def by_hand(docs, target, n=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, n)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + float(buckets)) / ((s[b] + 1.0) * (all_t + float(buckets))))) for b in {*s, *t}}
    return [(i, len(words(x)), len(features(x, n)), sum(gain[bucket(f)] for f in features(x, n))) for i, x in docs]


def drawn(weighted, percent, least):
    noise = lambda i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
    scored = [(*r, r[3] + noise(r[0])) for r in weighted]
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = {k: n for n, k in enumerate(sorted(range(len(fit)), key=lambda k: k), 1) if n <= len(fit) * percent // 100}
    return sorted([(*r, rank.get(k)) for k, r in enumerate(fit)] + [(*r, None) for r in scored if r[1] < least], key=repr)


ODD = [(0, None), (1, ""), (2, " .,!\n"), (3, "one"), (4, "A b-C a B c"), (4, "A b-C a B c"), (None, "naïve Ünder 日本語 x1"), (None, "tie tie"), (-7, "é" * 5000 + " " + "word other " * 2000), (8, "a\x00b\x7fc `d{e"), (4, "another text of four")]


def frame(spark, data):
    return spark.createDataFrame([(i, x, "z", 1, "t", 0.5, 3, "w") for i, x in data], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("batch", ["2", "1000"])
def test_weights_of_odd_rows(spark, n, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, batch)
    try:
        target = ["a b c a b", None, "word other word", "日本語 x1 unseen"]
        aim = spark.createDataFrame([(x,) for x in target], "text string")
        got = resample.importance(frame(spark, ODD).repartition(3), aim, n=n, buckets=97)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(by_hand(ODD, target, n, 97), key=repr)
        ranked = resample.draw(got, percent=40, least_words=2)
        assert sorted(((r["id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in ranked.collect()), key=repr) == drawn(by_hand(ODD, target, n, 97), 40, 2)
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def test_empty_tables(spark):
    none, aim = frame(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert resample.draw(resample.importance(none, aim)).collect() == []
    got = resample.importance(frame(spark, ODD), aim.limit(0), n=2).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(by_hand(ODD, [], 2), key=repr)
    with pytest.raises(ValueError):
        resample.importance(none, aim, buckets=0)


def test_each_distinct_tuple_is_hashed_once(spark):
    data = [(i, "a b a b") for i in range(50)]
    mark = len(resample.keep.__globals__["_kept"])
    got = resample.importance(frame(spark, data).repartition(5), spark.createDataFrame([("b c",)], "text string"), n=2)
    assert {tuple(r)[1:] for r in got.collect()} == {by_hand(data, ["b c"], 2)[0][1:]}
    path = next(name for _, name in resample.keep.__globals__["_kept"][mark:] if "tuples-hashed" in name)
    assert spark.read.parquet(path).count() == 6  # a, b, c, a b, b a, b c


def test_query_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows("documents", "doc_id", "text")]
    target = [r["text"] for r in rows("benchmark", "text")]
    got = queries.op13_importance_resampling(spark, SF).collect()
    expected = drawn(by_hand(docs, target), 10, 20)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=repr) == sorted(((i, f, w, s, k) for i, _, f, w, s, k in expected), key=repr)


def test_a_row_group_holds_one_block_and_no_task_collects_gains(spark):
    name, mark = "spark.sql.execution.arrow.maxRecordsPerBatch", len(resample.keep.__globals__["_kept"])
    was = spark.conf.get(name, None)
    spark.conf.set(name, "2")
    try:
        out = resample.importance(frame(spark, ODD).coalesce(1), spark.createDataFrame([("a b",)], "text string"))
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(by_hand(ODD, ["a b"]), key=repr)
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)
    folder = next(x for _, x in resample.keep.__globals__["_kept"][mark:] if "resample-blocks" in x).removeprefix("file:")
    groups = [meta.row_group(k).num_rows for f in Path(folder).glob("*.parquet") for meta in [pq.read_metadata(f)] for k in range(meta.num_row_groups)]
    assert groups == [1] * 6
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()

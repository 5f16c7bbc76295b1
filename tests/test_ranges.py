"""Points in intervals: bins, and the exact result, against plain versions."""

import random

from pyspark.sql import functions as F

from assayer.operators import ranges
from assayer.plans import evidence_queries


def test_lengths_of_one_kind_share_a_size_of_bins():
    lines = {1: 30, 2: 1022, 3: 2021, 4: 4590, 5: 6628, 6: 12136, 7: 15005, 8: 20322, 9: 20344, 10: 11033, 11: 2191, 12: 136, 13: 45, 14: 6, 15: 4}
    assert ranges.grains(lines) == [(8, 15)] and ranges.grains({}) == []
    apart = ranges.grains({0: 100, 20: 100, 40: 1})
    assert apart == [(0, 0), (20, 20), (40, 40)]
    rng = random.Random(5)
    for _ in range(500):
        counts = {k: rng.choice([1, 5, 1000, 10**6]) for k in rng.sample(range(63), rng.randint(1, 30))}
        under = {k: next(size for size, top in ranges.grains(counts) if k <= top) for k in counts}
        assert all(size - k <= ranges.BELOW for k, size in under.items())
        assert sum(n * (1 << max(0, k - under[k])) for k, n in counts.items()) <= (1 + ranges.EXTRA) * sum(counts.values())


def test_points_of_all_sizes_of_intervals_and_negative_ones(spark):
    rng = random.Random(3)
    sizes = [1, 2, 3, 5, 9, 17, 70, 900, 1 << 20, 1 << 45]
    intervals = [(k, s := rng.randint(-300, 300), s + rng.choice(sizes[:7] if k == "a" else sizes), i) for i, k in enumerate(rng.choices("ab", k=150))]
    points = [(k, rng.randint(-300, 1200), j) for j, k in enumerate(rng.choices("abc", k=200))]
    want = sorted((k, p, j, i) for k, p, j in points for k2, s, e, i in intervals if k == k2 and s <= p < e)
    left, right = spark.createDataFrame(points, "k string, p long, j int"), spark.createDataFrame(intervals, "k string, s long, e long, i int")
    assert sorted((r["k"], r["p"], r["j"], r["i"]) for r in ranges.points_in_intervals(left, right, ["k"], "p", "s", "e").collect()) == want
    bare = ranges.points_in_intervals(left.select("k", "p"), right, ["k"], "p", "s", "e")
    assert sorted((r["k"], r["p"], r["i"]) for r in bare.collect()) == sorted((k, p, i) for k, p, _, i in want)


def test_pieces_are_placed_within_their_row(spark):
    """No text or piece is shuffled, and pieces of long texts begin where the ones before end."""
    rows = [(1, "ab  cd\n\n e" * 200), (2, ""), (3, None), (4, "\n"), (5, "é x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = evidence_queries.pieces(docs, "doc_id", r"(?<=\n)", "line")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = []
    for d, t in rows:
        at = 0
        for n, s in enumerate(() if t is None else t.splitlines(True) + ([""] if t == "" or t.endswith("\n") else [])):
            want.append((d, n, at, at + len(s)))
            at += len(s)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    places = evidence_queries.pieces(docs, "doc_id", r"(?<=[ \n])(?=[^ \n])|(?<=[^ \n])(?=[ \n])", "n", words=True).where(F.col("doc_id") == 5).select("start", "end").collect()
    assert sorted(tuple(r) for r in places) == [(0, 1), (2, 3)]

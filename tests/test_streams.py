"""Streams against batches: limits in order, live links, chunked frames, replayed sinks, counts of cohorts; range joins and rounding."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import scores as S
from assayer.operators import cohort, ranges
from assayer.plans import evidence_queries
from assayer.sources import frames
from assayer.streaming import counters, ordered, sinks

SF = "/root/testdata/sf0.01"
T0 = dt.datetime(2024, 1, 1)


def drained(stream, path, name):
    """All that a stream gives over the files that are there, and the rows that its state still holds at the end."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{path}/{name}-out").option("checkpointLocation", f"{path}/{name}-cp").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}-out"), held


def in_files(spark, df, path, name, by, n):
    """``df`` as ``n`` files in the order of ``by``, read as a stream of one file a batch."""
    rows = df.orderBy(by).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")


def test_limits_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 2000").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", (F.col("user_id") % 10).alias("address"))
    batch = counters.first_exceeded(counters.running_counts(events, "user_id", "DAY", 2), counters.running_counts(events, "address", "HOUR", 2), "event_id")
    last = events.agg(F.max("ts") + F.expr("interval 5 days")).first()[0]
    end = [(last + dt.timedelta(days=i), -1 - i, -1 - i, -1 - i) for i in range(3)]
    stream = in_files(spark, events.unionByName(spark.createDataFrame(end, events.schema)), tmp_path, "e", "ts", 3)
    got, held = drained(ordered.limit_verdicts(stream, 2, 2), tmp_path, "limits")
    mine = {r["event_id"]: r["verdict"] for r in got.where("event_id >= 0").collect()}
    assert mine == {r["event_id"]: r["verdict"] for r in batch.collect()} and len(set(mine.values())) == 3
    assert got.count() == got.select("event_id").distinct().count()
    assert max(held) <= 20  # only what the last events have left


def test_a_link_stops_counting_when_it_is_revoked(spark, tmp_path):
    at = lambda minute: T0 + dt.timedelta(minutes=minute)
    changes = [("a", at(0), at(600)), ("b", at(0), at(600)), ("c", at(0), at(30)), ("b", at(45), at(45)), ("z", at(5000), at(9000))]
    views = [(t, i, at(m)) for t in "abcd" for i, m in enumerate([10, 29, 30, 44, 45, 46, 90])] + [("z", 99, at(5001))]
    rng = random.Random(1)
    rng.shuffle(views)
    changes_ = spark.createDataFrame(changes, "token string, ts timestamp, expires_at timestamp")
    views_ = spark.createDataFrame(views, "token string, event_id long, ts timestamp")
    out = ordered.counted_views(in_files(spark, views_, tmp_path, "v", "event_id", 2), in_files(spark, changes_, tmp_path, "c", "ts", 1), late="2 days")
    got, _ = drained(out, tmp_path, "views")
    minute = lambda r: round((r["ts"] - T0).total_seconds() / 60)
    counted = {(r["token"], minute(r)) for r in got.where("token <> 'z'").collect() if r["counted"]}
    links = spark.createDataFrame([("a", None, at(600)), ("b", at(45), at(600)), ("c", None, at(30))], "token string, revoked_at timestamp, expires_at timestamp")
    batch = {r["token"]: r["view_count"] for r in counters.views(views_, links, "token").collect()}
    assert counted == {("a", m) for m in (10, 29, 30, 44, 45, 46, 90)} | {("b", m) for m in (10, 29, 30, 44)} | {("c", m) for m in (10, 29)}
    assert batch == {t: sum(k == t for k, _ in counted) for t in "abc"}


TEXT = "event: progress\ndata: {\"n\": 1}\n\n: keep-alive\n\ndata: {\"n\": 2}\n\n\n\n\ndata: broken\n\nevent: done\r\ndata: {\"n\": 3}\r\n\r\ndata: {\"n\": 4}\n"


def cut(rng, text):
    at = sorted(rng.sample(range(len(text) + 1), rng.randint(0, min(len(text), 30))))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def test_frames_cut_at_any_character(spark, tmp_path):
    rng = random.Random(2)
    texts = [TEXT, "", "\n\n", "\n\n\n", "no break", "a\n\nb"] + ["".join(rng.choices(["\n", "\n\n", "a", "b"], k=rng.randint(1, 20))) for _ in range(25)]
    rows = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate([*t] if i in (0, 3, 7, 9) else cut(rng, t))] + [(99, 0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, seq long, chunk string")
    expected = {(i, k): raw for i, t in enumerate(texts) for k, raw in enumerate(t.replace("\r", "").split("\n\n")[:-1])}
    assert {(r["id"], r["pos"]): r["raw"] for r in frames.from_chunks(df).collect()} == expected
    whole = frames.parse(spark.createDataFrame([(0, TEXT)], "id long, text string"), "id", "text", "n int")
    assert [tuple(r) for r in frames.parsed(frames.from_chunks(df.where("id = 0")), "id", "n int").orderBy("pos").collect()] == [tuple(r) for r in whole.orderBy("pos").collect()]
    stamped = df.withColumn("r", F.rand(3)).withColumn("ts", F.lit(T0))
    end = spark.createDataFrame([(-1, 0, "", 2.0, T0 + dt.timedelta(days=9))], stamped.schema)
    stream = in_files(spark, stamped.unionByName(end), tmp_path, "k", "r", 3)
    got, held = drained(ordered.chunk_frames(stream), tmp_path, "chunks")
    assert {(r["id"], r["pos"]): r["raw"] for r in got.collect()} == expected and got.count() == len(expected)
    assert held[0] <= 3  # the last text's, and its timer


RUNS = "resume_id int, user_id int, resume string, file_hash string, job_id int, job string, jd_hash string, id int, scores string, report string, created_at string, content_hash string"


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    run = lambda r, fh, i, ch: (r, 1, f"r{r}", fh, 5, "job", "j", i, "s", "rep", "t", ch)
    batches = [[run(1, "a", 10, "x"), run(1, "a", 11, "y"), run(1, "a", 11, "y")], [run(1, "a", 10, "x"), run(2, "b", 12, "z")], [run(1, "A", 10, "w")]]
    folder, write = str(tmp_path / "runs"), sinks.save_runs(str(tmp_path / "runs"))
    frames_ = [spark.createDataFrame(b, RUNS) for b in batches]
    state = lambda: {n: sorted(tuple(r) for r in sinks._read(spark, f"{folder}/{n}", sinks._batches(spark, f"{folder}/{n}"), ", ".join(f"{c} {frames_[0].schema[c].dataType.simpleString()}" for c in cs)).collect()) for n, cs in sinks.RUN_TABLES.items()}
    for k, df in enumerate(frames_):
        write(df, k)
    once = state()
    for k in (1, 2, 0):
        write(frames_[k], k)
    assert state() == once
    assert [r[:1] + r[3:] for r in once["resumes"]] == [(1, "A", 2), (1, "a", 0), (2, "b", 1)] and len(once["job_targets"]) == 1 and len(once["analyses"]) == 4
    now = sinks.saved(spark, folder, "resumes", "resume_id int, user_id int, resume string, file_hash string")
    assert sorted((r["resume_id"], r["file_hash"]) for r in now.collect()) == [(1, "A"), (2, "b")]


def test_cohorts_grow_by_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["x", "y", None]), None if rng.random() < 0.1 else round(rng.gauss(50, 20), 1), float(rng.randint(0, 5))) for _ in range(900)]
    schema = "role string, overall double, ats double"
    folder = str(tmp_path / "counts")
    write = sinks.count_samples(folder, ["role"], ["overall", "ats"], merge_every=2)
    for k in range(5):
        write(spark.createDataFrame(rows[k * 180 : k * 180 + 180], schema), k)
        write(spark.createDataFrame(rows[k * 180 : k * 180 + 180], schema), k)  # replayed
        counts = sinks.sample_counts(spark, folder, "role:string,metric:string,value:double,n:bigint")
        got = sorted(map(tuple, cohort.percentiles_of_counts(counts, ["role"]).collect()), key=repr)
        assert got == sorted(map(tuple, cohort.percentiles(spark.createDataFrame(rows[: k * 180 + 180], schema), ["role"], ["overall", "ats"]).collect()), key=repr) and got
    assert sinks._batches(spark, f"{folder}/merged") == [1, 3]


def test_chunks_are_dealt_apart_and_sorted_once(spark):
    """Partitions of users aren't merged by the size of frames, and one sort serves all windows over chunks."""
    plan = evidence_queries.chunked_frames(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    chunks = spark.createDataFrame([(1, 0, "a")], "id int, seq int, chunk string")
    assert frames.from_chunks(chunks)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_points_in_intervals(spark):
    rng = random.Random(9)
    points = [(rng.choice("ab"), rng.randint(-50, 5000)) for _ in range(300)] + [("a", None), (None, 3)]
    intervals = [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 3, 60, 1000, 100_000]), i) for i, s in enumerate(rng.choices(range(-60, 5000), k=200))] + [("a", None, 4, -1), ("a", 3, None, -2), ("a", 9, 2, -3), (None, 0, 9, -4)]
    p = spark.createDataFrame(sorted(set(points), key=repr), "k string, at long")
    got = ranges.points_in_intervals(p, spark.createDataFrame(intervals, "k string, s long, e long, i int"), ["k"], "at", "s", "e")
    want = {(k, at, i) for k, at in set(points) for c, s, e, i in intervals if None not in (k, at, s, e) and k == c and s <= at < e}
    rows = [(r["k"], r["at"], r["i"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    none = spark.createDataFrame([], "k string, s long, e long, i int")
    assert ranges.points_in_intervals(p, none, ["k"], "at", "s", "e").count() == 0
    assert ranges.points_in_intervals(p, none, ["k"], "at", "s", "e", "left").count() == p.count()


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_rounding_by_the_exact_value(spark, digits):
    rng = random.Random(digits)
    xs = [0.15, 2.675, 0.5, 1.5, 2.5, -0.5, -2.5, 0.125, 0.375, 1e300, -1e300, 0.0, 1e-320, 70.5, 4503599627370497.0, 2.5e15]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 11) for _ in range(5000)] + [rng.randint(-(10**6), 10**6) / 10 ** rng.randint(1, 6) for _ in range(5000)] + [rng.randint(-(10**5), 10**5) / 8 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [(r["x"], r["y"]) for r in df.select("x", S.round_half_even(F.col("x"), digits).alias("y")).collect()]
    assert [(x, y) for x, y in got if y != round(x, digits)] == []
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(S.round_half_even(F.col("x"), digits).alias("y")).collect()
    assert str([r["y"] for r in odd]) == "[nan, inf, None]"

"""Limits, usage and view counters.

Stream forms keep one small state a key and window and drop it by watermark.
Batch forms give, over a finished table, what the stream gives in the end.
Event times that are ``timestamp_ntz`` are read as UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMITS = {"day": ("DAY", 5), "hour": ("HOUR", 20)}


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``events`` with ``ts`` as a timestamp, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def running_counts(events: DataFrame, key: str, unit: str, limit: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each event's number within its key and window, and whether it is over the limit.

    Counting in order needs a key's events of one window together; windows are
    hours or days, so a frequent key is split over them.
    """
    start = F.date_trunc(unit, F.col(ts))
    order = Window.partitionBy(key, start).orderBy(ts, tie)
    return events.withColumn("window_start", start).withColumn("hits", F.row_number().over(order)).withColumn("allowed", F.col("hits") <= limit)


def window_counts(events: DataFrame, key: str, unit: str, limit: int, ts: str = "ts") -> DataFrame:
    """Hits of each key and window and how many were over the limit; partial sums before the shuffle."""
    out = events.groupBy(F.col(key), F.date_trunc(unit, F.col(ts)).alias("window_start")).agg(F.count("*").alias("hits"))
    return out.withColumn("denied", F.greatest(F.lit(0), F.col("hits") - limit).cast("long"))


def window_counts_stream(events: DataFrame, key: str, width: str, limit: int, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The same over a stream: tumbling windows of ``width``, closed ``late`` after their end."""
    out = timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key)).agg(F.count("*").alias("hits"))
    return out.select(key, F.col("w.start").alias("window_start"), "hits", F.greatest(F.lit(0), F.col("hits") - limit).cast("long").alias("denied"))


def sliding_counts_stream(events: DataFrame, key: str, width: str, slide: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts over sliding windows."""
    return timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), F.col(key)).agg(F.count("*").alias("hits")).select(key, F.col("w.start").alias("window_start"), "hits")


def session_counts_stream(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts over sessions that end after ``gap`` without events."""
    return timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("hits")).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hits")


def first_exceeded(user: DataFrame, address: DataFrame, id_col: str) -> DataFrame:
    """One verdict from two limits on the same events: the first that is exceeded, else allowed. A missing count allows."""
    a = user.select(id_col, F.col("allowed").alias("user_ok"))
    b = address.select(id_col, F.col("allowed").alias("address_ok"))
    verdict = F.when(~F.coalesce("user_ok", F.lit(True)), "user_day").when(~F.coalesce("address_ok", F.lit(True)), "address_hour").otherwise("allowed")
    return a.join(b, id_col, "full_outer").select(id_col, verdict.alias("verdict"))


def daily_usage(events: DataFrame, model: str, tokens: str, cap: float, near: float = 0.85, ts: str = "ts") -> DataFrame:
    """Requests and tokens by day and model, the day's total, and whether it is near or over ``cap`` requests."""
    by = events.groupBy(F.date_trunc("DAY", F.col(ts)).cast("date").alias("day"), F.col(model).alias("model")).agg(F.count("*").alias("requests"), F.round(F.sum(tokens), 4).alias("tokens"))
    day = by.groupBy("day").agg(F.sum("requests").alias("day_requests"))
    return by.join(day, "day").withColumn("near_limit", F.col("day_requests") >= near * cap).withColumn("exhausted", F.col("day_requests") >= cap)


def views(events: DataFrame, links: DataFrame, token: str, ts: str = "ts") -> DataFrame:
    """Views of live links only: events joined with links as they were at the event. Works on a stream joined with a static table."""
    live = F.col("revoked_at").isNull() | (F.col("revoked_at") > F.col(ts))
    return events.join(links.select(F.col("token").alias(token), "revoked_at", "expires_at"), token).where(live & (F.col("expires_at") > F.col(ts))).groupBy(token).agg(F.count("*").alias("view_count"))


def prune(counters: DataFrame, now: Column, days: int = 2) -> DataFrame:
    """Counters without windows that began more than ``days`` ago."""
    return counters.where(F.col("window_start") >= now - F.make_dt_interval(F.lit(days)))


def token_bucket(events: DataFrame, key: str, per_minute: float, capacity: float, ts: str = "ts") -> DataFrame:
    """A bucket a key, refilled ``per_minute``: ``allowed`` and ``waits`` (seconds until a token) of every event of a stream.

    State is two numbers a key and goes once the watermark is an hour past its last event.
    """
    state = "tokens double, at double"
    kind = events.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        rows = pd.concat(list(batches)).sort_values([ts])
        tokens, at = kept.get if kept.exists else (capacity, None)
        out = []
        for t in (pd.Timestamp(x).timestamp() for x in rows[ts]):
            tokens = min(capacity, tokens + (0 if at is None else max(0.0, t - at) * per_minute / 60))
            at = t if at is None else max(at, t)
            ok = tokens >= 1
            out.append((ok, 0.0 if ok else (1 - tokens) * 60 / per_minute))
            tokens -= ok
        kept.update((float(tokens), float(at)))
        kept.setTimeoutTimestamp(max(int(at * 1000) + 3_600_000, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: keys[0], ts: rows[ts].to_numpy(), "allowed": [a for a, _ in out], "waits": [w for _, w in out]})

    return timed(events, ts).withWatermark(ts, "1 hour").select(key, ts).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp, allowed boolean, waits double", state, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there now, and read the result: appended files, or with ``complete`` the last whole table."""
    spark: SparkSession = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

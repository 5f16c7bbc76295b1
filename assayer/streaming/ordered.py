"""Keyed state over streams: events of a key in the order of their times, whatever order they arrive in.

``InOrder`` holds a key's events until the watermark has passed them, and then
steps through them by time; so a stream gives what a window function over the
finished table gives, one row an event. Its state is what is still to come and one
small row; a timer wakes the key when there is something to do, and the row goes as
soon as no later event can need it. Needs the RocksDB state store (``stores``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, DAY = 3_600_000_000, 86_400_000_000


def stores(spark: SparkSession) -> None:
    """Use the state store that ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Steps through a key's events by time. Subclasses say what one step does and when their state may go."""

    #: Columns of an event that are held, the first two being its time in microseconds and a tie-breaker.
    columns: tuple[str, ...] = ()
    held: str = ""
    kept: str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.held)
        self.state = handle.getValueState("state", self.kept)

    def step(self, state: tuple | None, event: tuple) -> tuple[tuple, tuple | None]:
        """The state after an event, and what the event gives (None: nothing)."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int:
        """Time in microseconds after which the state says nothing that its absence doesn't."""
        raise NotImplementedError

    def row(self, key: Any, out: tuple) -> Row:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # a key's rows of one batch may come in several calls, so nothing is stepped through before the timers' turn
        events = [tuple(r[c] for c in self.columns) for r in rows]
        self.pending.appendList(events)
        self.handle.registerTimer(-(-min(e[0] for e in events) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._pass(key, timerValues)

    def _pass(self, key: Any, timers: Any) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.pending.get())
        due = [e for e in events if e[0] <= now]
        left = events[len(due) :]
        state = tuple(self.state.get()) if self.state.exists() else None
        for event in due:
            state, out = self.step(state, event)
            if out is not None:
                yield self.row(key, out)
        if due:
            self.pending.clear()
            if left:
                self.pending.put(left)
        if state is not None:
            if not left and self.ends(state) <= now:
                self.state.clear()
                state = None
            elif due:
                self.state.update(state)
        wakes = ([left[0][0]] if left else []) + ([self.ends(state)] if state is not None else [])
        if wakes and min(wakes) > now:
            self.handle.registerTimer(-(-min(wakes) // 1000))

    def close(self) -> None:
        pass


class Limit(InOrder):
    """Whether each event is among the first ``limit`` of its key and window; earlier verdicts go along."""

    columns, held, kept = ("at", "event_id", "user_id", "address", "user_ok"), "at long, event_id long, user_id long, address long, user_ok boolean", "start long, hits long"

    def __init__(self, unit: int, limit: int, of_user: bool) -> None:
        self.unit, self.limit, self.of_user = unit, limit, of_user

    def step(self, state: tuple | None, event: tuple) -> tuple[tuple, tuple]:
        start = event[0] // self.unit * self.unit
        hits = state[1] + 1 if state and state[0] == start else 1
        return (start, hits), (*event, hits <= self.limit)

    def ends(self, state: tuple) -> int:
        return state[0] + self.unit

    def row(self, key: Any, out: tuple) -> Row:
        at, event_id, user_id, address, user_ok, ok = out
        return Row(ts=_stamp(at), at=at, event_id=event_id, user_id=user_id, address=address, user_ok=ok if self.of_user else user_ok, address_ok=None if self.of_user else ok)


def _stamp(micros: int) -> Any:
    from datetime import UTC, datetime, timedelta

    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)


_LIMITED = "ts timestamp, at long, event_id long, user_id long, address long, user_ok boolean, address_ok boolean"


def limit_verdicts(events: DataFrame, per_day: int, per_hour: int, late: str = "10 minutes") -> DataFrame:
    """One verdict an event of a stream (``ts``, ``event_id``, ``user_id``, ``address``): the first limit that it exceeds.

    ``user_day`` counts by user and day, ``address_hour`` by address and hour, both in
    the order of times and ids; two keyed steps follow one another. A verdict comes
    once the watermark has passed its event.
    """
    stores(events.sparkSession)
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "user_id", "address", F.lit(None).cast("boolean").alias("user_ok")).withWatermark("ts", late)
    by_user = rows.groupBy("user_id").transformWithState(Limit(DAY, per_day, True), _LIMITED, "append", "EventTime", eventTimeColumnName="ts")
    by_address = by_user.groupBy("address").transformWithState(Limit(HOUR, per_hour, False), _LIMITED, "append", "EventTime", eventTimeColumnName="ts")
    return by_address.select("event_id", F.when(~F.col("user_ok"), "user_day").when(~F.col("address_ok"), "address_hour").otherwise("allowed").alias("verdict"))


class LiveLink(InOrder):
    """Views of a link while it lives: a link begins with its first change, and ends when it expires or is revoked."""

    columns, held, kept = ("at", "kind", "event_id", "expires"), "at long, kind int, event_id long, expires long", "expires long"

    def step(self, state: tuple | None, event: tuple) -> tuple[tuple, tuple | None]:
        at, kind, event_id, expires = event
        until = state[0] if state else 0
        if kind == 0:  # made, or made to end at another time
            return (expires,), None
        return (until,), (event_id, at, at < until)

    def ends(self, state: tuple) -> int:
        return state[0]

    def row(self, key: Any, out: tuple) -> Row:
        return Row(token=key[0], event_id=out[0], ts=_stamp(out[1]), counted=out[2])


def counted_views(views: DataFrame, changes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Every view (``token``, ``event_id``, ``ts``) of a stream, and whether its link lived then.

    ``changes``: a stream of ``token``, ``ts`` and ``expires_at``, a row when a link is
    made or is given another end; a revocation is a change whose end is its own time.
    Changes come before views of the same time.
    """
    stores(views.sparkSession)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = changes.select("token", F.col("ts").cast("timestamp").alias("ts"), micros("ts").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("event_id"), micros("expires_at").alias("expires"))
    b = views.select("token", F.col("ts").cast("timestamp").alias("ts"), micros("ts").alias("at"), F.lit(1).alias("kind"), "event_id", F.lit(None).cast("long").alias("expires"))
    both = a.unionByName(b).withWatermark("ts", late)
    kind = both.schema["token"].dataType.simpleString()
    return both.groupBy("token").transformWithState(LiveLink(), f"token {kind}, event_id long, ts timestamp, counted boolean", "append", "EventTime")


class Chunks(StatefulProcessor):
    """Frames of a text that comes in numbered chunks: the part after the last break is carried to the next chunk."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "next long, frames long, text string, until long")
        self.early = handle.getListState("early", "seq long, chunk string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        number, frames, text, until = self.rest.get() if self.rest.exists() else (0, 0, "", 0)
        early = {e[0]: e[1] for e in self.early.get()}
        for r in rows:
            until = max(until, r["at"] // 1000 + self.silence_ms)
            if r["seq"] >= number:  # one that was sent again is known already
                early[r["seq"]] = r["chunk"] or ""
        while number in early:
            text += early.pop(number).replace("\r", "")
            number += 1
            *whole, text = text.split("\n\n")
            for raw in whole:
                yield Row(id=key[0], pos=frames, raw=raw)
                frames += 1
        self.rest.update((number, frames, text, until))
        self.early.clear()
        if early:
            self.early.put(sorted(early.items()))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.rest.exists() and self.rest.get()[3] <= timerValues.getCurrentWatermarkInMs():
            self.rest.clear()
            self.early.clear()
        return iter(())

    def close(self) -> None:
        pass


def chunk_frames(chunks: DataFrame, silence_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Raw frames (``id``, ``pos``, ``raw``) of a stream of ``id``, ``seq`` (from 0), ``chunk`` and ``ts``, as soon as they are whole.

    Chunks may come in any order and more than once. A text that has had no chunk for
    ``silence_ms`` of event time is forgotten.
    """
    stores(chunks.sparkSession)
    kind = chunks.schema["id"].dataType.simpleString()
    rows = chunks.select("id", "seq", "chunk", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withWatermark("ts", late)
    return rows.groupBy("id").transformWithState(Chunks(silence_ms), f"id {kind}, pos long, raw string", "append", "EventTime")

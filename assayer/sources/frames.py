"""Server-sent event frames: writing them from rows and reading them back from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(event: Column, data: Column) -> Column:
    """One frame: event name and JSON on one line each, then a blank line."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def progress(rows: DataFrame, columns: list[str], event: str = "progress") -> DataFrame:
    """Rows with their ``frame``."""
    return rows.withColumn("frame", frame(F.lit(event), F.to_json(F.struct(*columns))))


def heartbeats(rows: DataFrame, by: list[str], ts: str = "ts", seconds: int = 5) -> DataFrame:
    """Comment frames that keep a connection open: keys, ``ts`` and ``frame``, one every ``seconds`` after an event until the run's next one."""
    following = F.lead(ts).over(Window.partitionBy(*by).orderBy(ts))
    step = F.make_dt_interval(secs=F.lit(seconds))
    gaps = rows.select(*by, F.col(ts).alias("__from"), following.alias("__to")).where(F.col("__to") > F.col("__from") + step)
    beats = F.filter(F.sequence(F.col("__from") + step, F.col("__to"), step), lambda t: t < F.col("__to"))
    return gaps.select(*by, F.explode(beats).alias(ts), F.lit(": keep-alive\n\n").alias("frame"))


def parse(texts: DataFrame, id_col: str, text_col: str, schema: str) -> DataFrame:
    """Frames of whole texts: id, ``pos``, ``event``, ``data``. Comments and frames with broken JSON are dropped, as is an unfinished last one."""
    parts = F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n\n")
    whole = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = texts.select(F.col(id_col), F.posexplode(whole).alias("pos", "raw"))
    return parsed(rows, id_col, schema)


def from_chunks(chunks: DataFrame, id_col: str = "id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Raw frames of texts that come in numbered chunks, cut at any character: id, ``pos``, ``raw``.

    Breaks are counted, so that each piece of a chunk knows its frame's number; pieces
    of a frame then meet in one group, and no text is ever put together as a whole. A
    break may be cut itself: a chunk hands an odd line break at its end to the next
    one, for which running sums over the chunks' line breaks suffice. Carriage returns
    are dropped, null chunks are empty, and so is an unfinished last frame. Chunks are
    sorted once, for all that is counted over them.
    """
    order = Window.partitionBy(id_col).orderBy(seq)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.replace(F.coalesce(F.col(chunk), F.lit("")), F.lit("\r"), F.lit(""))
    rows = chunks.select(F.col(id_col), F.col(seq), text.alias("text"))
    rows = rows.withColumn("tail", F.length(F.regexp_extract("text", r"(\n*)$", 1))).withColumn("only", F.col("tail") == F.length("text"))
    # line breaks since the last other character: those so far, less those before the last chunk with another
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sofar", F.sum("tail").over(here)).withColumn("since", F.last(F.when(~F.col("only"), F.col("sofar") - F.col("tail")), ignorenulls=True).over(here))
    rows = rows.withColumn("past", (F.col("sofar") - F.coalesce("since", F.lit(0))) % 2)
    handed = F.coalesce(F.lag("past").over(order), F.lit(0)).cast("int")
    whole = F.concat(F.repeat(F.lit("\n"), handed), F.col("text"))
    rows = rows.withColumn("w", whole).withColumn("w", F.when(F.col("past") == 1, F.expr("left(w, length(w) - 1)")).otherwise(F.col("w")))
    pieces = rows.select(id_col, seq, F.split("w", "\n\n", -1).alias("pieces")).withColumn("first", F.coalesce(F.sum(F.size("pieces") - 1).over(before), F.lit(0)))
    every = Window.partitionBy(id_col)
    pieces = pieces.withColumn("frames", F.sum(F.size("pieces") - 1).over(every))
    each = pieces.select(id_col, seq, "first", "frames", F.posexplode("pieces").alias("k", "piece")).withColumn("pos", F.col("first") + F.col("k")).where(F.col("pos") < F.col("frames"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "piece"))), lambda p: p["piece"]), "")
    return each.groupBy(id_col, "pos").agg(joined.alias("raw"))


def parsed(raw: DataFrame, id_col: str, schema: str) -> DataFrame:
    """Raw frames as events: id, ``pos``, ``event``, ``data``; comments and frames with broken JSON go."""
    lines = F.filter(F.split("raw", "\n"), lambda x: ~x.startswith(":"))
    of = lambda p: F.transform(F.filter(lines, lambda x: x.startswith(p)), lambda x: F.regexp_replace(x, f"^{p} ?", ""))
    json = F.array_join(of("data:"), "\n")
    out = raw.select(id_col, "pos", F.coalesce(F.get(of("event:"), F.lit(0)), F.lit("message")).alias("event"), F.from_json(json, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("data"), json.alias("json"))
    return out.where(F.get_json_object("json", "$").isNotNull()).drop("json")

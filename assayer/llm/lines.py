"""Removal of repeated lines by overlapping three-line windows.

Every three consecutive lines of a document are hashed. A hash that occurs more
than once in the corpus marks a repeated window; its first occurrence (smallest
document, then earliest line) stays, and the lines that later ones cover go.
Covered positions of overlapping windows merge, so a long repeat goes as one.

Hashing needs no shuffle; equal rows need no prior deduplication, as their
windows have equal places; hashes are counted with partial aggregation, and the
occurrences of repeated windows come from one equi-join on the hash, which
Spark splits where a hash is frequent. No group is ever collected: a document
gathers only its own covered line numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import free_name

WINDOW = 3


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id``, ``copy`` (a hash of the text), ``pos`` (from 0) and ``hash`` of each window of consecutive lines."""
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.xxhash64(F.trim(x)))
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), lines.alias("lines")).where(F.size("lines") >= window)
    blank = F.xxhash64(F.lit(""))
    at = F.sequence(F.lit(1), F.size("lines") - (window - 1))
    hashes = F.transform(at, lambda i: F.when(F.exists(F.slice("lines", i, window), lambda h: h != blank), F.xxhash64(*[F.element_at("lines", i + j) for j in range(window)])))
    return docs.select("id", "copy", F.posexplode(hashes).alias("pos", "hash")).where(F.col("hash").isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the lines gone that later occurrences of repeated windows cover.

    Lines are cut at ``\\n`` and compared without blanks at their ends; a window
    of blank lines only never counts. All columns are kept, with the new text in
    ``text_col``, and ``removed_lines`` is added. Windows are judged on the input.
    The order of occurrences is that of ids (null first), then of text hashes for
    equal ids, then of lines; rows equal in id and text are one document and are
    treated alike. A null text stays null, texts of fewer lines than a window
    stay as they are, and an empty table gives an empty result. An older column
    ``removed_lines`` gives way; others stay, whatever they are called. Very long texts are
    read whole, a text at a time in a task, in time that grows with their lines.
    """
    windows = line_windows(docs, id_col, text_col, window)
    place = F.struct("id", "copy", "pos")
    repeated = windows.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("hash", "first")
    later = windows.join(repeated, "hash").where(~place.eqNullSafe(F.col("first")))
    spots = later.groupBy("id", "copy").agg(F.collect_set("pos").alias("spots"))
    gone = F.array_distinct(F.flatten(F.transform("spots", lambda p: F.sequence(p, p + (window - 1)))))
    kept = [c for c in docs.columns if c.lower() != "removed_lines"]
    i, copy, s_id, s_copy, gone_col = (free_name(docs, c) for c in ("__id", "__copy", "__s_id", "__s_copy", "__gone"))
    # the lines, not the text, go through the join: they are cut once
    rows = docs.select(*[F.split(F.col(c), "\n", -1).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], F.col(id_col).alias(i), F.xxhash64(text_col).alias(copy))
    out = rows.join(spots.select(F.col("id").alias(s_id), F.col("copy").alias(s_copy), gone.alias(gone_col)), F.col(i).eqNullSafe(F.col(s_id)) & (F.col(copy) == F.col(s_copy)), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(text_col) - 1), F.coalesce(gone_col, F.array().cast("array<int>")))
    text = F.array_join(F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(F.transform(left, lambda k: F.element_at(text_col, k + 1))), "\n")
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], F.coalesce(F.size(gone_col), F.lit(0)).cast("long").alias("removed_lines"))

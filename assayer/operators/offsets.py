"""Text changes that keep a way back: Unicode folding and redaction with offsets.

Both need character-by-character work, so they run on Arrow batches; what they
return (offset lists, breaks) is used by plain expressions afterwards.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import privacy as P

#: Kinds of personal data, the stronger first.
KINDS = ("email", "url", "dob", "phone", "name", "location")
_PATTERNS = {k: re.compile(p) for k, p in (("email", P.EMAIL), ("url", P.URL), ("dob", P.BIRTH), ("phone", P.PHONE))}


_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_normal = cache(lambda ch: unicodedata.normalize("NFKC", ch))


def fold(text: str) -> tuple[str, list[int]]:
    """NFKC of ``text`` character by character, and where each result character came from. ASCII runs are copied whole."""
    out, source, at = [], [], 0
    for m in _FOREIGN.finditer(text):
        out.append(text[at : m.start()])
        source += range(at, m.start())
        at = m.end()
        for i, ch in enumerate(m[0], m.start()):
            new = _normal(ch)
            out.append(new)
            source += [i] * len(new)
    out.append(text[at:])
    source += range(at, len(text))
    return "".join(out), source


#: Bytes of text worked on at once, at about: what is made of a text is many times its size.
PORTION = 1 << 20


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have ``PORTION`` bytes and one text more at most. Nothing is copied or left out."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes) - sizes
    first = 0
    while first < batch.num_rows:
        past = max(first + 1, int(np.searchsorted(before, before[first] + PORTION, "right")))
        yield batch.slice(first, past - first)
        first = past


def folded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``folded`` text and ``sources`` (offset in the text of each folded character); null texts stay null."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            done = [None if t is None else (t, range(len(t))) if t.isascii() else fold(t) for t in batch.column(1).to_pylist()]
            sources = [None if d is None else np.arange(len(d[1]), dtype=np.int32) if isinstance(d[1], range) else np.array(d[1], np.int32) for d in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d and d[0] for d in done], pa.string()), pa.array(sources, pa.list_(pa.int32()))], names=["id", "folded", "sources"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("folded", T.StringType()), T.StructField("sources", T.ArrayType(T.IntegerType()))]))


def original_span(sources: Column, start: Column, end: Column) -> Column:
    """``struct<start, end>`` in the original of a span of the folded text; null if it is empty or outside."""
    ok = (start >= 0) & (end > start) & (end <= F.size(sources))
    return F.when(ok, F.struct(F.get(sources, start).alias("start"), (F.get(sources, end - 1) + 1).alias("end")))


def redact_text(text: str, known: list[tuple[str, str]]) -> dict:
    """``text`` with numbered placeholders for patterns and ``known`` (kind, value) pairs.

    Of overlapping finds the first stays, then the longest, then the stronger
    kind. One value has one placeholder, whatever its case.
    """
    found = [(m.start(), m.end(), k) for k, p in _PATTERNS.items() for m in p.finditer(text)]
    for kind, value in known:
        value = value.strip()
        parts = [value] + ([x for x in value.split() if len(x) >= 4] if kind == "name" else [])
        for v in parts:
            if len(v) >= 3:
                found += [(m.start(), m.end(), kind) for m in re.finditer(rf"(?<!\w){re.escape(v)}(?!\w)", text, re.I)]
    out, at, values, numbers, breaks, shifts, shift, size = [], 0, {}, {}, [], [], 0, 0
    for start, end, kind in sorted(found, key=lambda f: (f[0], f[0] - f[1], KINDS.index(f[2]))):
        if start < at:
            continue
        value = text[start:end]
        if (kind, value.lower()) not in values:
            numbers[kind] = numbers.get(kind, 0) + 1
            mark = f"[{kind.upper()}]" if numbers[kind] == 1 else f"[{kind.upper()}_{numbers[kind]}]"
            values[kind, value.lower()] = (mark, value)
        mark = values[kind, value.lower()][0]
        out += [text[at:start], mark]
        size += start - at + len(mark)
        shift += end - start - len(mark)
        breaks.append(size)
        shifts.append(shift)
        at = end
    return {"text": "".join([*out, text[at:]]), "values": list(values.values()), "breaks": breaks, "shifts": shifts}


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contact_col: str | None = None) -> DataFrame:
    """``id``, ``redacted`` text, ``placeholders`` (map to the first value seen), ``breaks`` and ``shifts``.

    ``contact_col``: a struct of name, email, phone, location, links, as
    ``sections.contact`` makes it. Null texts stay null.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(contact_col) if contact_col else F.lit(None).cast("struct<name:string,email:string,phone:string,location:string,links:array<string>>")).alias("contact"))

    def known(c: dict | None) -> list[tuple[str, str]]:
        c = c or {}
        return [(k, c[k]) for k in ("name", "email", "phone", "location") if c.get(k)] + [("url", u) for u in c.get("links") or () if u]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if t is None else redact_text(t, known(c)) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            of = lambda k, kind: pa.array([d and d[k] for d in done], kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), of("text", pa.string()), of("values", pa.map_(pa.string(), pa.string())), of("breaks", pa.list_(pa.int32())), of("shifts", pa.list_(pa.int32()))], names=["id", "redacted", "placeholders", "breaks", "shifts"])

    ints = T.ArrayType(T.IntegerType())
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("redacted", T.StringType()), T.StructField("placeholders", T.MapType(T.StringType(), T.StringType())), T.StructField("breaks", ints), T.StructField("shifts", ints)]))


def restored(text: Column, placeholders: Column) -> Column:
    """The text with values back in place of placeholders, longer placeholders first."""
    order = F.array_sort(F.map_entries(placeholders), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(order, text, lambda t, e: F.replace(t, e["key"], e["value"]))


def original_offset(offset: Column, breaks: Column, shifts: Column) -> Column:
    """Where a character of the redacted text stood in the original; inside a placeholder, where its value began."""
    n = F.size(F.filter(breaks, lambda b: b <= offset))
    return offset + F.when(n > 0, F.get(shifts, n - 1)).otherwise(0)

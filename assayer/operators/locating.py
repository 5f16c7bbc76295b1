"""Many strings sought in their own texts at once, forgiving about dress but not about words.

A text's needles are grouped in shares of bounded size, so a text that a third of
all needles ask about is read in as many rows, by as many tasks. One
Aho-Corasick automaton a share finds all of them in one pass over the text, and a
second one, over the text with its white space collapsed, those that the first left.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import AROUND

#: Needles of a share, at about.
SHARE = 1024


def machine_of(needles: Iterable[str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for n in needles:
        machine.add_word(n, n)
    if len(machine):
        machine.make_automaton()
    return machine


def places(text: str, needles: Iterable[str] | ahocorasick.Automaton) -> dict[str, list[int]]:
    """Every place where each of ``needles`` begins, overlapping ones too; only found ones are named."""
    machine = needles if isinstance(needles, ahocorasick.Automaton) else machine_of(needles)
    found: dict[str, list[int]] = {}
    if len(machine):
        for last, n in machine.iter(text):
            found.setdefault(n, []).append(last + 1 - len(n))
    return found


def collapsed(text: str) -> tuple[str, list[int], list[int]]:
    """Words joined by one blank, where each begins there, and where in ``text``."""
    words, there, here, at, size = text.split(), [], [], 0, 0
    for w in words:
        at = text.index(w, at)
        there.append(size)
        here.append(at)
        at += len(w)
        size += len(w) + 1
    return " ".join(words), there, here


def locate_all(text: str, needles: Sequence[str]) -> list[tuple[str, list[tuple[int, int]]] | None]:
    """For each needle its form and all (start, end) in ``text``: as it is, else trimmed, else with other white space; or None."""
    bare = [n.strip(AROUND) for n in needles]
    found = places(text, {n for n in (*needles, *bare) if n})
    out = [("exact", [(s, s + len(n)) for s in found[n]]) if n in found else ("trimmed", [(s, s + len(b)) for s in found[b]]) if b in found else None for n, b in zip(needles, bare)]
    left = {i: " ".join(b.split()) for i, (b, o) in enumerate(zip(bare, out)) if o is None}
    left = {i: b for i, b in left.items() if b}
    if left:
        plain, there, here = collapsed(text)
        found = places(plain, set(left.values()))

        def back(k: int) -> int:
            word = bisect_right(there, k) - 1
            return here[word] + k - there[word]

        for i, b in left.items():
            if b in found:
                out[i] = "collapsed", [(back(s), back(s + len(b) - 1) + 1) for s in found[b]]
    return out


def _sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        forms, spots = [], []
        for text, share in zip(batch["__text"], batch["__share"]):
            got = locate_all(text.as_py() or "", [n["needle"] for n in share.as_py()])
            forms.append([g and g[0] for g in got])
            spots.append([[{"start": a, "end": b} for a, b in g[1]] if g else None for g in got])
        kept = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(forms, pa.list_(pa.string())), pa.array(spots, pa.list_(pa.list_(place)))], names=[*(batch.schema.names[i] for i in kept), "__forms", "__spots"])


def located(documents: DataFrame, needles: DataFrame, by: Sequence[str], id_col: str, text_col: str = "text", needle_col: str = "needle") -> DataFrame:
    """Each needle that stands in its text: keys, ``id_col``, needle, ``form``, ``start`` and ``end`` of the first place, and all ``places``.

    A needle is sought as it is; then without bullets, blanks and stops around it;
    then with any white space between its words. Null and empty needles, ones of
    trimmed characters only, and ones whose text is missing or null are not found.
    Equal rows count once; a key should name one document.
    """
    wanted = needles.where(F.col(needle_col).isNotNull()).select(*by, F.col(id_col).alias("__id"), F.col(needle_col).alias("__needle")).distinct()
    shares = wanted.groupBy(*by).agg(F.ceil(F.count("*") / SHARE).alias("__shares"))
    dealt = wanted.join(shares, list(by)).withColumn("__part", F.pmod(F.xxhash64("__id", "__needle"), F.col("__shares")))
    grouped = dealt.groupBy(*by, "__part").agg(F.collect_list(F.struct(F.col("__id").alias("id"), F.col("__needle").alias("needle"))).alias("__share")).drop("__part")
    met = grouped.join(documents.select(*by, F.col(text_col).alias("__text")), list(by))
    fields = ", ".join(f"`{c}` {grouped.schema[c].dataType.simpleString()}" for c in grouped.columns)
    out = met.select(*grouped.columns, "__text").mapInArrow(_sought, f"{fields}, __forms array<string>, __spots array<array<struct<start: int, end: int>>>")
    each = out.select(*by, F.explode(F.arrays_zip("__share", "__forms", "__spots")).alias("x")).where("x.__forms IS NOT NULL")
    first = F.col("x.__spots")[0]
    return each.select(*by, F.col("x.__share.id").alias(id_col), F.col("x.__share.needle").alias(needle_col), F.col("x.__forms").alias("form"), first["start"].alias("start"), first["end"].alias("end"), F.col("x.__spots").alias("places"))


def anywhere(documents: DataFrame, needles: DataFrame, id_col: str, needle_id: str, text_col: str = "text", needle_col: str = "needle", most_chars: int = 4 << 20) -> DataFrame:
    """First places of needles in any text, as they are: ``id_col``, ``needle_id``, ``start``.

    Needles go to the tasks in blocks of ``most_chars`` characters at about, a pass over
    the texts each; a block is one automaton, so texts never meet needles pair by pair.
    Null texts and null or empty needles meet nothing; equal needles meet under all
    their ids.
    """
    asked = needles.where(F.col(needle_col).isNotNull() & (F.col(needle_col) != "")).select(F.col(needle_id), F.col(needle_col).alias("__needle"))
    total = asked.agg(F.sum(F.length("__needle"))).first()[0] or 0
    blocks = -(-total // most_chars)
    kind = documents.schema[id_col].dataType.simpleString()
    found = None

    def sought(block: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = machine_of(block)
            for batch in batches:
                rows, names, starts = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for n, at in places(text or "", machine).items():
                        rows.append(i)
                        names.append(n)
                        starts.append(at[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int64())], names=[id_col, "__needle", "start"])

        return run

    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("__needle"), F.lit(blocks)) == b).select("__needle").distinct().toArrow()["__needle"].to_pylist()
        part = documents.select(id_col, text_col).mapInArrow(sought(block), f"`{id_col}` {kind}, __needle string, start long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.limit(0).join(needles.limit(0).select(needle_id)).select(id_col, needle_id, F.lit(0).cast("long").alias("start"))
    return found.join(asked, "__needle").select(id_col, needle_id, "start")

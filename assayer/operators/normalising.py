"""Layout normalisation whose steps can be traced back: each returns its text and an offset map, and maps compose.

A map is a list of pieces: the place in the new text where a piece begins, and the
place in the old text of its first character; within a piece both run in step. Text
that a step leaves alone costs nothing but a piece, so a map is as long as its step
has edits, not as the text. Two maps compose by a merge of their sorted pieces.
Steps run on whole texts in Arrow batches; spans are mapped back by expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.offsets import portions

#: Characters that stand for others, and marks that begin a list item.
FIXED = {" ": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
BULLETS, BULLET = "•·‣⁃▪▫◦●○■□–—*-", "•"

_FOREIGN = re.compile(r"[^\x00-\x7f]")
_FIRST = re.compile(rf"(?m)(?<![^\n])[ \t]*([{re.escape(BULLETS)}])")
_HYPHEN = re.compile(r"(?<=[A-Za-z]{2})-\n(?=[a-z]{2})")
_LOWER = re.compile("[a-z]+")
_BLANKS = re.compile(r"[ \t]+(?=\n|$)|[ \t]{2,}|\t")
_LETTERS = re.compile(r"(?:[A-Za-z]\s){2,}[A-Za-z]")


@dataclass
class Map:
    """Pieces of a text of ``size`` characters: ``at`` in it, ``source`` in the text it was made from."""

    at: np.ndarray
    source: np.ndarray
    size: int

    def back(self, places: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.at, places, "right") - 1
        return self.source[piece] + places - self.at[piece]

    def after(self, earlier: Map) -> Map:
        """From this map's text to the text before ``earlier``'s step: pieces of both, merged in order."""
        ends = np.append(self.at[1:], self.size) - self.at + self.source
        low, high = np.searchsorted(earlier.at, self.source, "right"), np.searchsorted(earlier.at, ends, "left")
        counts = np.maximum(high - low, 0)
        owner = np.repeat(np.arange(len(self.at)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[owner]
        cuts = earlier.at[inner] - self.source[owner] + self.at[owner]  # where a piece of the earlier map begins inside one of this
        at = np.sort(np.concatenate([self.at, cuts]))
        return Map(at, earlier.back(self.back(at)), self.size)


def edited(text: str, edits: Iterable[tuple[int, int, str]]) -> tuple[str, Map]:
    """``text`` with (start, end, new) edits in order; every new character stands for the first that it replaces."""
    out, at, source, size, past = [], [0], [0], 0, 0
    for start, end, new in edits:
        out += [text[past:start], new]
        size += start - past
        for _ in new:
            at.append(size)
            source.append(start)
            size += 1
        at.append(size)
        source.append(end)
        past = end
    out.append(text[past:])
    size += len(text) - past
    at_, source_ = np.array(at, np.int64), np.array(source, np.int64)
    last = np.append(at_[1:] != at_[:-1], True)  # of pieces that begin at one place the last holds characters
    return "".join(out), Map(at_[last], source_[last], size)


def plain_characters(text: str) -> Iterator[tuple[int, int, str]]:
    """Fixed characters, and the compatibility form of every other one beyond ASCII."""
    for m in _FOREIGN.finditer(text):
        new = FIXED.get(m[0]) or unicodedata.normalize("NFKC", m[0])
        if new != m[0]:
            yield m.start(), m.end(), new


def one_bullet(text: str) -> Iterator[tuple[int, int, str]]:
    """One mark for all that begin a line."""
    for m in _FIRST.finditer(text):
        if m[1] != BULLET:
            yield m.start(1), m.end(1), BULLET


def joined_words(text: str) -> Iterator[tuple[int, int, str]]:
    """Words that a line break cut at a hyphen; what a join has used as its second half isn't the first half of another."""
    used = 0
    for m in _HYPHEN.finditer(text):
        if m.start() - 2 >= used:
            used = _LOWER.match(text, m.end()).end()
            yield m.start(), m.end(), ""


def single_blanks(text: str) -> Iterator[tuple[int, int, str]]:
    """One blank for a run of them, none at the end of a line."""
    for m in _BLANKS.finditer(text):
        yield m.start(), m.end(), "" if m.end() == len(text) or text[m.end()] == "\n" else " "


def closed_letters(text: str) -> Iterator[tuple[int, int, str]]:
    """Lines of single letters with blanks between them, closed up."""
    for first, past in spaced_lines(text):
        for k in range(first, past):
            if text[k] == " ":
                yield k, k + 1, ""


def spaced_lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        if _LETTERS.fullmatch(line.strip()):
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


STEPS: tuple[Callable[[str], Iterable[tuple[int, int, str]]], ...] = (plain_characters, one_bullet, joined_words, single_blanks, closed_letters)


def normalise(text: str) -> tuple[str, Map, int]:
    """The text after all steps, its map to the original, and the number of spaced lines that were closed."""
    whole, repairs = Map(np.zeros(1, np.int64), np.zeros(1, np.int64), len(text)), 0
    for step in STEPS:
        repairs = len(spaced_lines(text)) if step is closed_letters else repairs
        edits = list(step(text))
        if edits:
            text, own = edited(text, edits)
            whole = own.after(whole)
    return text, whole, repairs


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in portions(whole, 1)):
        done = [None if t is None else normalise(t) for t in batch.column(1).to_pylist()]
        of = lambda f, kind: pa.array([None if d is None else f(d) for d in done], kind)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([batch.column(0), of(lambda d: d[0], pa.string()), of(lambda d: d[1].at, pa.list_(pa.int32())), of(lambda d: d[1].source, pa.list_(pa.int32())), of(lambda d: d[2], pa.int32())], names=["id", "normalised", "at", "source", "repairs"])


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``normalised`` text, its pieces ``at`` and ``source``, and ``repairs`` (closed lines). A null text stays null, rows stay as many."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_batches, f"id {rows.schema['id'].dataType.simpleString()}, normalised string, at array<int>, source array<int>, repairs int")


def original_place(place: Column, at: Column, source: Column) -> Column:
    """Where the character at ``place`` of the normalised text stood: a search among the pieces."""
    halves = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(at).cast("double"))).cast("int")))
    start = F.struct(F.lit(0).alias("low"), F.size(at).alias("high"))
    mid = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    step = lambda s, _: F.when(s["high"] - s["low"] <= 1, s).when(F.get(at, mid(s)) <= place, F.struct(mid(s).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid(s).alias("high")))
    piece = F.aggregate(halves, start, step, lambda s: s["low"])
    return F.get(source, piece) + place - F.get(at, piece)


def original_span(start: Column, end: Column, at: Column, source: Column) -> Column:
    """``struct<start, end>`` in the original of a span of the normalised text, up to the last character inside it; null if it is empty."""
    return F.when(end > start, F.struct(original_place(start, at, source).alias("start"), (original_place(end - 1, at, source) + 1).alias("end")))

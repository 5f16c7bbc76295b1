"""Benchmark decontamination by template windows.

A text becomes a template: words lose punctuation at their ends and case, and
numbers, names and units give way to typed placeholders. A word is a number if
it holds a digit, a name if it begins with a capital of any script and isn't in
``COMMON``, wherever it stands, and a unit if it is in ``UNITS`` and follows a
number. Templates are cut into windows of ``window`` words (a shorter benchmark
item, of any length, is one window), which are joined by hash. A hit counts if its
slots are consistent: within a window, the benchmark's slot values must map to the
document's one to one, so a re-parameterised question is caught and a chance
meeting of placeholders is not. One-to-one means that the same places hold equal
values on both sides, so that pattern is part of the join's key.

Windows of the words themselves, without placeholders, are a second key for every
window. A template with fewer than ``LEAST_LITERALS`` words that aren't placeholders
says nothing ("<name> has <number>" fits any text), so such a window must agree word
by word: it has only this second key. A verbatim copy is therefore found however
short it is, however many numbers, names and units it has, and however it is wrapped
or capitalised.

The benchmark's window hashes are sent to tasks in blocks of ``BLOCK`` hashes
(32 MB), one pass over the documents a block, and only documents' windows that
are in a block reach the join. A benchmark of any size costs more passes, never
more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import arrays as A
from assayer.llm.shared import free_name, keep

WINDOW = 13
#: Words of a template window that must not be placeholders; a window with fewer is compared word by word.
LEAST_LITERALS = 3
BLOCK = 4_000_000
#: Seed that keeps hashes of words apart from hashes of templates.
VERBATIM = 1 << 20
#: Units of measure.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs min mins h hr hrs day days week weeks month months year years hz khz mhz ghz v w kw mw kwh j kj pa kpa c f k percent % usd eur gbp dollars euros pounds cents meters metres kilometers kilometres miles feet inches hours minutes seconds grams kilograms liters litres".split()
#: Words that are no names where they begin a sentence.
COMMON = "a an the this that these those if when while where what which who whom whose why how is are was were do does did has have had can could will would shall should may might must i you he she it we they my your his her its our their me him us them there here in on at by for from with without of to and or but not no nor so as than then after before during since until each every all any some both either neither one two three let suppose given find calculate compute determine solve choose consider explain describe write name state show prove".split()
NUMBER, NAME, UNIT = 11, 12, 13
#: Marks that are words of their own where they stand alone, as in a sum; other lone marks are no words.
OPERATORS = b"+*/=<>^"
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCT[ord("%")] = False
_OPERATOR = np.zeros(256, bool)
_OPERATOR[list(OPERATORS)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hash_of(words: list[str]) -> np.ndarray:
    w = A.words_of(*A.texts_of(pa.array([" ".join(words)])))
    return np.sort(A.word_hashes(w))


_UNITS, _COMMON = _hash_of(UNITS), _hash_of(COMMON)


class Templates:
    """Template words of a batch: ``token`` (hash of the literal, or of the placeholder), ``literal`` (hash of the word itself), ``slot`` (0 for literals, else the value's hash), ``words`` (places)."""

    def __init__(self, text: pa.Array) -> None:
        buf, offs = A.texts_of(text)
        w = A.words_of(buf, offs)
        low = A.lowered(buf)
        plain = np.flatnonzero(~_PUNCT[buf])
        after = np.searchsorted(plain, w.start)  # the first and the last byte of a word that is no mark
        before = np.searchsorted(plain, w.end) - 1
        marks = after > before
        ends = np.r_[plain, 0]
        start, end = np.where(marks, w.start, ends[after]), np.where(marks, w.end, ends[before] + 1)
        kept = ~marks | (w.end - w.start == 1) & _OPERATOR[buf[w.start]] if len(marks) else marks
        start, end, doc = start[kept], end[kept], w.doc[kept]
        self.doc = doc
        self.words = A.Words(low, start, end, doc, np.searchsorted(doc, np.arange(len(offs))))
        self.literal = literal = A.word_hashes(self.words)
        digits = np.r_[0, np.cumsum(_DIGIT[buf])]
        number = digits[end] > digits[start]
        name = A.capitals(buf, start) & ~number & ~A.member(literal, _COMMON)
        follows = np.r_[False, number[:-1] & (doc[1:] == doc[:-1])] if len(start) else number
        unit = follows & ~number & A.member(literal, _UNITS)
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0)))
        self.slot = np.where(kind > 0, literal, np.uint64(0)).astype(np.uint64)
        self.token = np.where(kind > 0, A.mix(kind.astype(np.uint64), 3), literal).astype(np.uint64)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``n`` words that have literals enough."""
        if len(self.token) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        free = np.r_[0, np.cumsum(self.slot == 0)]
        ok = A.whole(self.doc, n) & (free[n:] - free[:-n] >= LEAST_LITERALS)
        at = np.flatnonzero(ok)
        return at, A.rolling(self.token, n, n)[at]

    def verbatim(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows of ``n`` words, by the words themselves."""
        at = np.flatnonzero(A.whole(self.doc, n))
        return at, A.rolling(self.literal, n, n + VERBATIM)[at]

    def patterns(self, at: np.ndarray, n: int) -> np.ndarray:
        """Which slots of each window are equal to which, as a number: windows with equal numbers map slots one to one."""
        out = np.zeros(len(at), np.int64)
        for k, i in enumerate(at.tolist()):
            order: dict[int, int] = {}
            pattern = [order.setdefault(x, len(order)) for x in self.slot[i : i + n].tolist() if x]
            out[k] = int.from_bytes(blake2b(repr(pattern).encode(), digest_size=8).digest(), "little", signed=True)
        return out


_WINDOWS = "id long, copy long, pos int, n int, hash long, pattern long, exact boolean"


def _windows(rows: DataFrame, lengths, among: np.ndarray | None, window: int) -> DataFrame:
    """Windows of ``rows`` (id, copy, text). ``lengths`` gives the windows' lengths for numbers of words; only hashes in ``among``, if given, else only whole texts below ``window``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for i, j in A.slices(text):
                t = Templates(text.slice(i, j - i))
                sizes = np.diff(t.words.first)
                for n in sorted(lengths(sizes)):
                    for exact in (False, True):
                        at, h = t.verbatim(n) if exact else t.windows(n)
                        hit = A.member(h, among) if among is not None else (sizes[t.doc[at]] == n) | (n >= window)
                        at, h = at[hit], h[hit]
                        if not len(at):
                            continue
                        doc = t.doc[at]
                        take = pa.array(doc + i)
                        pattern = np.zeros(len(at), np.int64) if exact else t.patterns(at, n)
                        columns = [pa.array((at - t.words.first[doc]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(h.view(np.int64)), pa.array(pattern), pa.array(np.full(len(at), exact))]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=["id", "copy", "pos", "n", "hash", "pattern", "exact"])

    return rows.mapInArrow(run, _WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each document that holds a window of a benchmark item.

    Returns ``id``, ``copy`` (hash of the text), ``item_ids`` (distinct,
    ascending), ``n_windows`` (its windows that hit) and ``verbatim`` (whether
    all slots of some hit are the item's own). An item of fewer than ``window``
    words is one window, so an item of a word or two is found wherever these
    words stand together: leave such items out of ``benchmark`` if that is too
    much. Null texts, and texts and items without words, hold nothing; a null id
    is an id of its own; rows equal in id and text are one document; ties don't
    arise, as all hits count; columns beside id and text are not read, so their
    names don't matter; empty tables give an empty result. Very long texts are
    read whole: a task holds one at a time, at about 200 bytes a word.
    """
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.lit(0).cast("long").alias("copy"), F.col(text_col).alias("text"))
    their = keep(_windows(items, lambda sizes: {window} | {int(n) for n in sizes if 0 < n < window}, None, window).select("id", "n", "hash", "pattern").distinct(), "templates")
    shape = their.agg(F.count_distinct("hash").alias("n"), F.collect_set("n").alias("lengths")).first()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    hits, lengths = None, set(shape["lengths"])
    blocks = max(1, -(-shape["n"] // block))
    for b in range(blocks):
        some = their.where(F.pmod("hash", F.lit(blocks)) == b).select("hash").distinct().toArrow()["hash"].to_numpy()
        part = _windows(rows, lambda _: lengths, np.sort(some.view(np.uint64)), window)
        hits = part if hits is None else hits.unionByName(part)
    # items that share a window are one entry of the join: a common window doesn't multiply
    entries = their.groupBy("hash", "pattern").agg(F.sort_array(F.collect_set("id")).alias("items"))
    met = hits.join(entries, ["hash", "pattern"])
    return met.groupBy("id", "copy").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"), F.count_distinct("pos", "n").alias("n_windows"), F.max("exact").alias("verbatim"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns, whatever these are called; null texts stay. Odd rows: see ``contaminated``."""
    i, copy = free_name(docs, "__id"), free_name(docs, "__copy")
    bad = contaminated(docs, benchmark, id_col, text_col, window=window).select(F.col("id").alias(i), F.col("copy").alias(copy))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(copy)), "left_anti")

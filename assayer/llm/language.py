"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts byte 4-grams by language over all training texts. An n-gram
belongs to a language if it makes up ``LEAST_SHARE`` of that language's n-grams
at least (so a language has ``1 / LEAST_SHARE`` n-grams at most, whatever the
corpus) and a fair part of its share in any other language. One table holds all
filters: each slot is a mask with a bit a language, and ANDing an n-gram's slots
gives all languages that contain it. A text's count for each language, corrected
for that filter's false positives, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import arrays as A

N = 4
PROBES = 3
#: At most 100,000 n-grams a language.
LEAST_SHARE = 1e-5
#: Of the largest share that any language has of the n-gram.
FAIR_PART = 0.2
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of a batch of texts as 32-bit numbers, and the text of each. Case is folded, what is no letter in ASCII is a blank, and n-grams over two blanks in a row are left out."""
    text = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(text.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    buf, offs = A.texts_of(text)
    b = _FOLD[A.lowered(buf)]
    if len(b) < N:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    g = sum(b[i : len(b) - N + 1 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(N))
    twice = np.r_[False, (b[1:] == 32) & (b[:-1] == 32), False]
    bad = np.zeros(len(g), bool)
    for i in range(1, N):
        bad |= twice[i : i + len(g)]
    at = np.flatnonzero(~bad)
    return g[at], np.searchsorted(offs, at, "right") - 1


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``gram`` and ``n`` over all texts whose language is known."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang = batch.column(1), batch.column(0).dictionary_encode()
            for i, j in A.slices(text, 4 * A.SPAN):
                codes = lang.indices.slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.uint64)
                g, doc = grams(text.slice(i, j - i))
                keys, n = np.unique(codes[doc] << np.uint64(32) | g, return_counts=True)
                names = lang.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _slots(g: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = A.mix(g.astype(np.uint64), 7)
    step = h >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


class Filters:
    """All languages' filters: ``table`` has a mask a slot; ``false`` is each language's false-positive rate."""

    def __init__(self, langs: list[str], members: list[np.ndarray], usual: str | None) -> None:
        self.langs, self.usual = langs, usual
        most = max([1, *map(len, members)])
        size = 1 << int(np.ceil(np.log2(16 * most)))
        self.planes = [np.zeros(size, np.uint8) for _ in range(0, len(langs), 8)]
        self.false = np.zeros(len(langs))
        for k, g in enumerate(members):
            bits = np.zeros(size, bool)
            for at in _slots(g, size):
                bits[at] = True
            self.planes[k // 8] |= bits.astype(np.uint8) << (k % 8)
            self.false[k] = bits.mean() ** PROBES

    def counts(self, g: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams that each language contains, and the n-grams of each text."""
        first = np.searchsorted(doc, np.arange(docs + 1))
        n, out = np.diff(first), np.zeros((docs, len(self.langs)))
        size = len(self.planes[0]) if self.planes else 1
        at = list(_slots(g, size))
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for x in at[1:]:
                mask &= plane[x]
            for k in range(8 * p, min(8 * p + 8, len(self.langs))):
                hit = np.cumsum(np.r_[0, mask >> (k % 8) & 1], dtype=np.int64)
                share = np.diff(hit[first]) / np.maximum(n, 1)
                out[:, k] = np.clip((share - self.false[k]) / (1 - self.false[k]), 0, 1)
        return out, n


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> Filters:
    """Filters of the languages of ``docs``; rows without text or language take no part, equal rows count as often as they come, an empty table gives no languages."""
    from assayer.llm.shared import keep

    counted = keep(count_grams(docs, text_col, lang_col), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least_share)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    got = shares.join(most, "gram").where(F.col("share") >= FAIR_PART * F.col("most")).select("lang", "gram").toArrow().to_pandas()
    total = {r["lang"]: r["total"] for r in totals.collect()}
    langs = sorted(total)
    members = [np.sort(got.loc[got["lang"] == x, "gram"].to_numpy(np.uint32)) for x in langs]
    return Filters(langs, members, min(langs, key=lambda x: (-total[x], x)) if langs else None)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score`` of every whole text, a row each.

    The score is the winner's part of all languages' corrected counts. A null
    text or one without letters is ``und`` with score 0; a text with letters of
    which no language knows an n-gram gets the commonest language, score 0; a
    tie goes to the first language by name. Without learned languages all is ``und``.
    Equal rows stay and get equal predictions; an empty table gives an empty
    result; columns beside id and text are not read, so their names don't matter.
    A text of any length is read whole, alone in a slice, at about 60 bytes a byte.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in A.slices(batch.column(1)):
                text = batch.column(1).slice(i, j - i)
                share, _ = filters.counts(*grams(text), j - i)
                buf, offs = A.texts_of(text)
                letter = np.r_[0, np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))]
                letters = np.diff(letter[offs]) > 0
                for k in np.flatnonzero(~letters & (np.diff(offs) > 0)):
                    letters[k] = any(map(str.isalpha, text[int(k)].as_py()))
                total = share.sum(1) if filters.langs else np.zeros(j - i)
                best = share.argmax(1) if filters.langs else np.zeros(j - i, int)
                score = np.where(letters & (total > 0), (share.max(1) if filters.langs else total) / np.maximum(total, 1e-300), 0.0)
                names = [UNKNOWN if not ok or filters.usual is None else filters.langs[b] if t > 0 else filters.usual for ok, b, t in zip(letters.tolist(), best.tolist(), total.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")

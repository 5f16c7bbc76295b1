"""Removal of word passages that occur more than once in a corpus (fixed-block anchors).

Every run of ``min_words`` words holds a whole block of ``(min_words + 1) // 2``
words that starts at a multiple of the block length. So:

1. *Index and probe.* Each chunk of documents hashes its non-overlapping blocks
   (the index) and every rolling window of the same length (the probes). Both
   go to hash-range buckets as one sorted, difference-coded list per chunk and
   bucket; a hash that occurs thousands of times in a chunk is sent once.
2. *Hits.* A bucket answers each chunk with those of its hashes that are an
   indexed block somewhere and occur twice at least: the anchors.
3. *Extension.* Around its anchors a chunk extends each hit to all windows of
   ``min_words`` words that hold it, and the buckets say which of these start
   anywhere else. Overlapping repeated windows merge into maximal repeats.

No pair of occurrences is ever formed, so a passage in n documents costs n.
Chunks are dealt at random, never by content: copies do not meet in one task.
Documents are kept in a bucketed table, so the two later passes over their
texts shuffle only the answers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import arrays as A
from assayer.llm.shared import keep_bucketed

CHUNK_BYTES = 8 << 20
BUCKET_WORDS = 1 << 20
_SENT = "bucket long, chunk long, hashes binary, block binary, multi binary"
_ANSWER = "chunk long, hashes binary"


def _deal(chunk: int, h: list[np.ndarray], block: list[np.ndarray], bits: int, buckets: int) -> list[tuple]:
    """Distinct hashes of a chunk, of ``bits`` bits, by bucket, with flags: an indexed block; more than one occurrence."""
    if not sum(map(len, h)):
        return []
    h, block = np.concatenate(h), np.concatenate(block)
    order = np.argsort(h, kind="stable")
    h, block = h[order], block[order]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    h, multi, block = h[new], np.diff(np.r_[new, len(h)]) > 1, np.logical_or.reduceat(block, new)
    bucket = h // np.uint64(-(-(1 << bits) // buckets)) if buckets > 1 else np.zeros(len(h), np.uint64)
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(h)].tolist()
    return [(int(bucket[i]), chunk, A.pack(h[i:j]), np.packbits(block[i:j]).tobytes(), np.packbits(multi[i:j]).tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _sent(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ("bucket", "chunk", "hashes", "block", "multi")
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, columns, strict=True)})


def _prober(block: int, bits: int, buckets: int):
    def probe(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        hashes, starts, text = [], [], docs["text"].combine_chunks()
        for i, j in A.slices(text):
            w = A.words_of(*A.texts_of(text.slice(i, j - i)))
            at = np.flatnonzero(A.whole(w.doc, block))
            hashes.append((A.rolling(A.word_hashes(w), block) >> np.uint64(64 - bits))[at])
            starts.append((at - w.first[w.doc[at]]) % block == 0)
        return _sent(_deal(key[0].as_py(), hashes, starts, bits, buckets))

    return probe


def _meet(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    """Answers to each chunk: its hashes that are an indexed block and occur twice at least over all chunks."""
    lists = [A.unpack(x) for x in sent["hashes"].to_pylist()]
    flags = [[np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(sent[c].to_pylist(), lists, strict=True)] for c in ("block", "multi")]
    h, block, multi = np.concatenate(lists), np.concatenate(flags[0]), np.concatenate(flags[1])
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    new = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    many = (np.diff(np.r_[new, len(h)]) > 1) | np.logical_or.reduceat(multi[order], new)
    found = sorted_[new][many & np.logical_or.reduceat(block[order], new)]
    answers = [(c, A.pack(x[A.member(x, found)])) for c, x in zip(sent["chunk"].to_pylist(), lists, strict=True)]
    answers = [x for x in answers if x[1]]
    return pa.table({"chunk": pa.array([c for c, _ in answers], pa.int64()), "hashes": pa.array([x for _, x in answers], pa.binary())})


def _told(answers: pa.Table) -> np.ndarray:
    """All hashes that a chunk was answered with, ascending."""
    lists = [A.unpack(x) for x in answers["hashes"].to_pylist()]
    return np.unique(np.concatenate(lists)) if lists else np.empty(0, np.uint64)


def _extender(min_words: int, block: int, bits: int, buckets: int):
    def extend(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        found, anchors = [], _told(answers)
        if not docs.num_rows or not len(anchors):
            return _sent([])
        text = docs["text"].combine_chunks()
        for i, j in A.slices(text):
            w = A.words_of(*A.texts_of(text.slice(i, j - i)))
            h = A.word_hashes(w)
            windows, fits = A.rolling(h, min_words), A.whole(w.doc, min_words)
            hit = np.flatnonzero(A.whole(w.doc, block))
            hit = hit[A.member(A.rolling(h, block)[hit] >> np.uint64(64 - bits), anchors)]
            from_ = np.maximum(hit - (min_words - block), 0)
            near = np.cumsum(np.bincount(from_, minlength=len(h) + 1) - np.bincount(hit + 1, minlength=len(h) + 1)) > 0
            at = np.flatnonzero(fits & near[: len(fits)])
            found.append(windows[at])
        return _sent(_deal(key[0].as_py(), found, [np.ones(len(x), bool) for x in found], 64, buckets))

    return extend


def _remover(min_words: int, kind: pa.DataType):
    def remove(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        repeated, out = _told(answers), {"id": [], "n_words": [], "spans": [], "kept": []}
        text = docs["text"].combine_chunks()
        for i, j in A.slices(text) if docs.num_rows else ():
            w = A.words_of(*A.texts_of(text.slice(i, j - i)))
            gone = np.zeros(len(w), bool)
            if len(repeated):
                at = np.flatnonzero(A.whole(w.doc, min_words))
                at = at[A.member(A.rolling(A.word_hashes(w), min_words)[at], repeated)]
                gone = A.covered(at, min_words, len(w))
            data = w.buf.tobytes()
            start, end = w.start.tolist(), w.end.tolist()
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
                spans = edge.reshape(-1, 2).tolist()
                kept = [k for lo, hi in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), b - a], strict=True) for k in range(a + lo, a + hi)]
                out["n_words"].append(b - a)
                out["spans"].append([{"first": x, "past": y} for x, y in spans])
                out["kept"].append(b" ".join([data[start[k] : end[k]] for k in kept]).decode())
        span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        return pa.table({"id": docs["id"].cast(kind), "n_words": pa.array(out["n_words"], pa.int64()), "spans": pa.array(out["spans"], span), "kept": pa.array(out["kept"], pa.string())})

    return remove


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35) -> DataFrame:
    """Each document without the words of any ``min_words``-word window that also starts elsewhere.

    Words are runs of characters other than ASCII white space, compared as they
    are. Windows are judged on the input. Returns one row per input row:
    ``id`` (long), ``n_words``, ``spans`` (removed word ranges, maximal, from 0,
    end excluded) and ``kept`` (the other words joined by one space).

    A null text has no words; a text shorter than a window loses nothing; equal
    rows are documents of their own, so both copies go; null ids are carried
    along; an empty table gives an empty result; other columns are not read, so
    their names don't matter. Very long texts are read whole: a task holds a
    chunk of 8 MB or one longer text, at about ten times its bytes.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    buckets = max(1, math.ceil(total / 6 / BUCKET_WORDS))
    bits = min(64, max(32, math.ceil(math.log2(max(2, total / 6))) + 13))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))
    rows = keep_bucketed(rows, "passages", "chunk", min(100_000, max(1, chunks // 4)))
    block = (min_words + 1) // 2
    by_chunk = rows.groupBy("chunk")
    anchors = by_chunk.applyInArrow(_prober(block, bits, buckets), _SENT).groupBy("bucket").applyInArrow(_meet, _ANSWER)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_extender(min_words, block, bits, buckets), _SENT)
    repeated = windows.groupBy("bucket").applyInArrow(_meet, _ANSWER)
    schema = "id long, n_words long, spans array<struct<first:long,past:long>>, kept string"
    return by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(_remover(min_words, pa.int64()), schema)

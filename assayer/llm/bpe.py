"""Byte-level BPE with a contiguous rank array per word.

Spark deals the rows; a task cuts its texts into words, encodes each word it has
not met lately once, and looks the others up. The words of one length form a
matrix of parts beside a matrix of the ranks of adjacent parts. Each step finds
every row's least rank, deletes that boundary and refreshes the two ranks beside
it, so all rows of a matrix stay equally wide until they are done. Words beyond
``SHORT`` bytes (a text without blanks is one word) take the least rank from a heap
instead of a scan, so their time grows as n log n.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assayer.llm import arrays as A

#: Words up to so many bytes are encoded in matrices.
SHORT = 48
#: Words that a task remembers; beyond, it forgets all but those at hand. Memory only: results don't depend on it.
REMEMBERED = 300_000
NONE = np.int32(0x7FFFFFFF)
#: Fixed value: the pattern that byte-level BPE cuts texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, Vocabulary] = {}


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of one vocabulary file, and the words a task has encoded."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, chars = file["model"]["vocab"], byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs] or [0], np.int32)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.r_[keys[order], np.int64(1 << 62)], np.r_[order, NONE].astype(np.int32)
        self.first = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.first[b] = ids[c]
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for s, i in ids.items():
            self.bytes[i] = raw(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.by_pair: dict[int, int] = {}

    @staticmethod
    def at(path: str) -> Vocabulary:
        if path not in _loaded:
            _loaded[path] = Vocabulary(path)
        return _loaded[path]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_short(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and ids of the rows that are done, step by step."""
        row, ranks = np.arange(len(parts)), self.rank(parts[:, :-1], parts[:, 1:])
        while len(row):
            if parts.shape[1] == 1:
                yield row, parts
                return
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                yield row[done], parts[done]
                row, parts, ranks, at, best = row[~done], parts[~done], ranks[~done], at[~done], best[~done]
            n, width, every = len(row), parts.shape[1], np.arange(len(row))
            parts = parts[np.arange(width) != at[:, None] + 1].reshape(n, width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            parts[every, at] = self.merged[best]
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.rank(parts[left, at[left] - 1], parts[left, at[left]])
            ranks[right, at[right]] = self.rank(parts[right, at[right]], parts[right, at[right] + 1])

    def merge_long(self, parts: np.ndarray) -> np.ndarray:
        """Ids of one word of any length: boundaries as a linked list, ranks in a heap, stale entries skipped."""
        n, none = len(parts), int(NONE)
        ids, after, before = parts.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(parts[:-1], parts[1:]).tolist() + [none]
        heap = [r * n + i for i, r in enumerate(ranks) if r != none]  # least rank first, then leftmost
        heapify(heap)
        rank_of, merged = self.ranks_by_pair(), self.merged.tolist()

        def refresh(i: int) -> None:
            r = rank_of.get(ids[i] << 32 | ids[after[i]], none)
            ranks[i] = r
            if r != none:
                heappush(heap, r * n + i)

        while heap:
            r, i = divmod(heappop(heap), n)
            if ranks[i] != r:
                continue
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = merged[r], -1, none
            after[i] = past = after[gone]
            if past < n:
                before[past] = i
                refresh(i)
            else:
                ranks[i] = none
            if before[i] >= 0:
                refresh(before[i])
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def ranks_by_pair(self) -> dict[int, int]:
        if not self.by_pair:
            self.by_pair = dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist(), strict=True))
        return self.by_pair

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        if not words:
            return
        buf, offs = A.texts_of(pa.array(words, pa.large_string()))
        size, names = np.diff(offs), np.array(words, object)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(size[order]) > 0, True])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = int(size[order[i]])
            if n > SHORT:
                for k in order[i:j].tolist():
                    self.known[words[k]] = self.merge_long(self.first[buf[offs[k] : offs[k + 1]]]).astype("<i4").tobytes()
                continue
            for at in range(i, j, 1 << 15):
                some = order[at : min(at + (1 << 15), j)]
                for rows, ids in self.merge_short(self.first[buf[offs[some][:, None] + np.arange(n)]]):
                    data = np.ascontiguousarray(ids, "<i4").view(f"V{4 * ids.shape[1]}").ravel().tolist()
                    self.known.update(zip(names[some[rows]].tolist(), data, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [[] if not t else self.cut.split(t) if self.cut else [t] for t in texts]
        found = [[[p] if i % 2 else self.words.findall(p) for i, p in enumerate(pieces)] for pieces in cut]
        met: set[str] = set().union(*(ws for pieces in found for ws in pieces[::2]))
        if len(self.known) + len(met) > REMEMBERED:
            self.known = {w: self.known[w] for w in met if w in self.known}
        self.learn(list(met.difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, ws)) if i % 2 == 0 else self.special[ws[0]].to_bytes(4, "little") for i, ws in enumerate(pieces)) for pieces in found]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


IDS = T.ArrayType(T.IntegerType())


def _added(df: DataFrame, columns: dict[str, T.DataType], by) -> DataFrame:
    """``df`` with columns computed from Arrow batches; ``by`` gives their arrays."""
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(batch.schema.get_field_index(by.reads)) if batch.num_rows else None
            for i, j in by.cut(whole) if batch.num_rows else ():
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, *by(whole.slice(i, j - i))], names=[*kept, *columns])

    return df.mapInArrow(run, schema)


class _Coder:
    """What a task does with a batch: reads one column, gives one or two."""

    def __init__(self, path: str, reads: str, encodes: bool, decodes: bool) -> None:
        self.path, self.reads, self.encodes, self.decodes = path, reads, encodes, decodes

    def cut(self, column: pa.Array) -> Iterator[tuple[int, int]]:
        """Row ranges that are worked on at once: about 2 MB of text."""
        return A.slices(column, 2 << 20) if self.encodes else ((i, min(i + 1000, len(column))) for i in range(0, len(column), 1000))

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        vocabulary, out = Vocabulary.at(self.path), []
        if self.encodes:
            data = vocabulary.encode(column.to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in data)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))
            out.append(column)
        if self.decodes:
            out.append(pa.array([None if x is None else vocabulary.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in column], pa.string()))
        return out


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text, special-token strings as the library reads them.

    A null or empty text has no ids. Repeated rows stay; an older column
    ``ids_col`` gives way; an empty table gives an empty result. ``path`` must be
    readable on every executor. Very long texts are encoded whole, alone in a
    task's slice, at about 30 bytes of memory a byte.
    """
    return _added(docs, {ids_col: IDS}, _Coder(path, text_col, True, False))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of every list of token ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD; a null list gives a null text, an empty
    one an empty text; repeated rows stay; an older column ``text_col`` gives way;
    an empty table gives an empty result. A list of any length is decoded whole.
    """
    return _added(docs, {text_col: T.StringType()}, _Coder(path, ids_col, False, True))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: one Python worker a task instead of two. Odd rows: see there; a null text decodes to an empty one."""
    return _added(docs, {ids_col: IDS, decoded_col: T.StringType()}, _Coder(path, text_col, True, True))

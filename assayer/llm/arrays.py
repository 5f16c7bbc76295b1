"""Words, hashes and rolling windows of a batch of texts as flat numpy arrays.

Tasks work on Arrow batches; nothing here touches Spark. A text is cut at the
six ASCII white-space bytes and the result is held as byte offsets, so a batch
costs a few passes over its bytes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes whose hashes are computed at once; bounds the temporary arrays.
SPAN = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if kind not in _tables or len(_tables[kind][0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[kind] | 1
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables[kind] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    up, down = _tables[kind]
    return up[:n], down[:n]


@dataclass
class Words:
    """Words of a batch: byte range, document number, and where each document's words begin."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, most: int = SPAN) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text stands alone."""
    _, offs = texts_of(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(buf: np.ndarray, offs: np.ndarray) -> Words:
    """Maximal runs of bytes other than ASCII white space, never across documents."""
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(buf, start, end, doc, first)


def word_hashes(w: Words, bytes_: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word; ``bytes_`` may give other bytes of equal length (lower-cased, say)."""
    buf, out = w.buf if bytes_ is None else bytes_, np.empty(len(w), np.uint64)
    i = 0
    while i < len(w):
        lo = w.start[i]
        j = max(i + 1, int(np.searchsorted(w.end, lo + SPAN, "right")))
        up, down = _powers("byte", int(w.end[j - 1] - lo))
        sums = np.zeros(len(up) + 1, np.uint64)
        np.cumsum(_BYTE[buf[lo : w.end[j - 1]]] * up, out=sums[1:])
        out[i:j] = (sums[w.end[i:j] - lo] - sums[w.start[i:j] - lo]) * down[w.start[i:j] - lo]
        i = j
    return mix(out, 1)


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of every ``k`` consecutive items, by the first item's place."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    up, down = _powers("word", len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1], seed + 2)


def whole(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the ``k`` items from each place belong to one document."""
    return doc[k - 1 :] == doc[: len(doc) - k + 1] if len(doc) >= k else np.empty(0, bool)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Items 0..n-1 that lie in a window of ``k`` from one of ``starts``."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + k, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit values as one width byte and fixed-width differences."""
    if not len(sorted_values):
        return b""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The values that ``pack`` was given."""
    if not blob:
        return np.empty(0, np.uint64)
    width = blob[0]
    steps = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _lower_table(first: int, past: int) -> np.ndarray:
    """Lower-case code points of ``first`` to ``past``, where they take as many UTF-8 bytes."""
    out = np.arange(first, past, dtype=np.int32)
    for c in range(first, past):
        low = chr(c).lower()
        if len(low) == 1 and low != chr(c) and first <= ord(low) < past:
            out[c - first] = ord(low)
    return out


_LOWER2, _LOWER3 = _lower_table(0x80, 0x800), _lower_table(0x800, 0x10000)


def lowered(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case; letters whose lower case has another length stay, and so do those beyond U+FFFF."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    two = np.flatnonzero((buf >= 0xC2) & (buf <= 0xDF))
    if len(two):
        low = _LOWER2[((buf[two] & 0x1F).astype(np.int32) << 6 | buf[two + 1] & 0x3F) - 0x80]
        out[two], out[two + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
    three = np.flatnonzero((buf >= 0xE0) & (buf <= 0xEF))
    if len(three):
        low = _LOWER3[((buf[three] & 0x0F).astype(np.int32) << 12 | (buf[three + 1] & 0x3F).astype(np.int32) << 6 | buf[three + 2] & 0x3F) - 0x800]
        out[three], out[three + 1], out[three + 2] = 0xE0 | low >> 12, 0x80 | low >> 6 & 0x3F, 0x80 | low & 0x3F
    return out


def capitals(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is an upper-case or title-case letter."""
    out = (buf[at] >= 65) & (buf[at] <= 90) if len(at) else np.empty(0, bool)
    wide = np.flatnonzero(buf[at] >= 0xC2) if len(at) else np.empty(0, np.int64)
    if len(wide):
        first = at[wide]
        size = np.where(buf[first] >= 0xF0, 4, np.where(buf[first] >= 0xE0, 3, 2))
        code = np.zeros(len(wide), np.uint32)
        for k in range(4):
            byte = np.where(k < size, buf[np.minimum(first + k, len(buf) - 1)], 0).astype(np.uint32)
            code |= byte << np.uint32(8 * k)
        kinds, which = np.unique(code, return_inverse=True)
        cased = [c.isupper() or c.istitle() for c in (int(x).to_bytes(4, "little").rstrip(b"\0").decode("utf-8", "replace") for x in kinds)]
        out[wide] = np.array(cased, bool)[which]
    return out

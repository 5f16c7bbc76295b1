"""A quality classifier by positive-unlabelled learning.

Texts become ``FEATURES`` style figures in Arrow batches. A logistic model over
the figures and their squares minimises the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``.
Trusted positives are rows labelled 1; the unlabelled sample is drawn from all rows,
labelled or not, with labels hidden. The class prior is estimated from scores: first
models tell positives from unlabelled rows, each fitted on one half of both samples
and asked about the other, and the smallest ratio of their shares above a cut,
guarded by a confidence term, is the part of the unlabelled rows that positives can
account for.
Rows labelled 0 are never told from unlabelled ones: they enter neither the risk nor
the prior.

Only the fit uses samples: about ``fit_rows`` positives and as many unlabelled
rows, those whose hash falls below a bound. Their figures
(about 300 bytes a row) go to the driver, which fits in numpy. Every row is scored
from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import arrays as A

FIT_ROWS = 20_000
#: Bytes of text whose figures are computed at once; bounds a task's memory.
SLICE = 2 << 20
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".", "comma": b",", "strong": b"!?", "pair": b"()[]{}", "quote": b"\"'`", "colon": b":;",
    "mark": b"#$%&*@^~", "bar": b"|\\/", "line": b"_-=+", "angle": b"<>", "space": b" \t", "break": b"\n\r", "other": bytes(range(128, 256)),
}
FEATURES = [*_CLASSES, "words", "length", "fresh", "stutter", "same_line", "in_word", "shout", "marked", "sentence"]


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by document."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.float64)][first])


def figures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The style figures of each text of a batch, a row each; zeros if empty."""
    w, n = A.words_of(buf, offs), np.maximum(np.diff(offs), 1)
    out = []
    table = np.zeros(256, np.uint8)
    for i, members in enumerate(_CLASSES.values(), 1):
        table[list(members)] = i
    kind = table[buf]
    for i in range(1, len(_CLASSES) + 1):
        out.append(_per(kind == i, offs) / n)
    words = np.maximum(np.diff(w.first), 1)
    h, doc, size = A.word_hashes(w), w.doc, (w.end - w.start).astype(np.float64)
    order = np.lexsort((h, doc))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if len(h) else np.empty(0, bool)
    stutter = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.empty(0, bool)
    last = kind[w.end - 1] if len(h) else np.empty(0, np.uint8)
    begin = kind[w.start] if len(h) else np.empty(0, np.uint8)
    names = list(_CLASSES)
    of = lambda k, *x: np.isin(k, [names.index(c) + 1 for c in x])
    second = kind[np.minimum(w.start + 1, w.end - 1)] if len(h) else np.empty(0, np.uint8)
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    after = edge[:-1].copy()
    after[1:] |= buf[:-1] == 10
    starts = np.flatnonzero(after & (buf != 10))
    ends = np.searchsorted(np.flatnonzero((buf == 10) | edge[1:]), starts)
    stops = np.flatnonzero((buf == 10) | edge[1:])[ends] if len(starts) else starts
    lines = A.word_hashes(A.Words(buf, starts, stops + (buf[stops] != 10), starts, starts)) if len(starts) else np.empty(0, np.uint64)
    of_doc = np.searchsorted(offs, starts, "right") - 1
    at = np.lexsort((lines, of_doc))
    again = np.zeros(len(lines), bool)
    if len(lines) > 1:
        again[1:] = (lines[at][1:] == lines[at][:-1]) & (of_doc[at][1:] == of_doc[at][:-1])
    count = np.bincount(of_doc, minlength=len(offs) - 1)
    out += [np.log1p(np.diff(w.first)), _per(size, w.first) / words, _per(new, w.first) / words ** 0.85, _per(stutter, w.first) / words, np.bincount(of_doc[at], again, minlength=len(offs) - 1) / np.maximum(count, 1)]
    out += [_per(of(second, "mark", "bar", "digit", "other"), w.first) / words, _per(of(second, "upper"), w.first) / words, _per(of(last, "mark", "bar", "strong"), w.first) / words, _per(of(begin, "upper"), w.first) / words]
    return np.stack(out, 1).astype(np.float64)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-2) -> dict[str, np.ndarray]:
    """Weights of the model from the figures of trusted positives and of unlabelled rows."""
    x = np.concatenate([positive, unlabelled])
    base = unlabelled if len(unlabelled) else x
    mid, wide = (base.mean(0), base.std(0) + 1e-6) if len(base) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    up, z = expand(positive, mid, wide), expand(unlabelled, mid, wide)
    weights = np.zeros(z.shape[1])
    if len(up) and len(z) and 0 < prior < 1:
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, steps + 1):
            g = gradient(weights, up, z, prior) + decay * weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    elif len(x):
        weights[-1] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    return {"mid": mid, "wide": wide, "weights": weights, "prior": np.array(prior)}


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(t / 2))


def gradient(weights: np.ndarray, up: np.ndarray, z: np.ndarray, prior: float) -> np.ndarray:
    """Step direction of the non-negative risk at ``weights``; where its second part is negative, that part is pushed back up."""
    p, u = up @ weights, z @ weights
    negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    grad_p = prior * (up.T @ -_sigmoid(-p)) / len(up)
    grad_n = z.T @ _sigmoid(u) / len(z) - prior * (up.T @ _sigmoid(p)) / len(up)
    return -grad_n if negative < 0 else grad_p + grad_n


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 20) -> float:
    """Estimated share of positives among the unlabelled rows, from scores; 0.5 if either sample has fewer than ``least`` rows."""
    if min(len(positive), len(unlabelled)) < least:
        return 0.5
    p, u = np.empty(len(positive)), np.empty(len(unlabelled))
    for half in (0, 1):  # each half is scored by the model of the other
        model = fit(positive[half::2], unlabelled[half::2], 0.5)
        for x, s in ((positive, p), (unlabelled, u)):
            s[1 - half :: 2] = expand(x[1 - half :: 2], model["mid"], model["wide"]) @ model["weights"]
    p, u = np.sort(p), np.sort(u)
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    guard = np.sqrt(np.log(40) / (2 * len(u))) + np.sqrt(np.log(40) / (2 * len(p)))
    best = int(np.argmin((above_u + guard) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def expand(x: np.ndarray, mid: np.ndarray, wide: np.ndarray) -> np.ndarray:
    z = np.clip((x - mid) / wide, -4, 4)
    return np.concatenate([z, z * z - 1, np.ones((len(z), 1))], 1)


def _figure_batches(name: str, by, *kept: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("__text"))
            for i, j in A.slices(text, SLICE):
                x = figures(*A.texts_of(text.slice(i, j - i)))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in kept), by(x)], names=[*kept, name])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, prior: float | None = None) -> dict[str, np.ndarray]:
    """The model of positives and unlabelled texts of ``docs``; ``prior`` is estimated unless given.

    Null texts take no part; rows with a null id are unlabelled; null labels and
    labels of null ids say nothing. Labels given twice for an id count as the
    larger. Equal rows count once. Without positives or without
    rows every text gets the prior (0.5 unless given) as its score. Columns beside
    id, text and label are not read. Long texts are read whole, one at a time.
    """
    known = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    own = rows.where(F.col("id").isNotNull()).select("id")
    n_all, n_pos = rows.count(), own.join(known, "id", "left_semi").count()
    part = lambda hash_, n: F.pmod(hash_, F.lit(1 << 30)) < int(min(1.0, fit_rows / max(n, 1)) * (1 << 30))
    # equal rows count once, so the samples stay bounded; the picked ids (8 bytes each) are about ``fit_rows``
    once = lambda df, label: df.select(F.xxhash64("id", "__text").alias("hash"), "__text").dropDuplicates(["hash"]).select(F.lit(label).alias("label"), "hash", "__text")
    hidden = once(rows.where(part(F.xxhash64("id", "__text"), n_all)), 0)
    pick = own.where(part(F.xxhash64("id"), n_pos)).join(known, "id", "left_semi").distinct()
    trusted = once(rows.join(F.broadcast(pick), "id", "left_semi"), 1)
    by = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
    got = trusted.unionByName(hidden).mapInArrow(_figure_batches("x", by, "label", "hash"), "label int, hash long, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    label, hash_ = got["label"].to_numpy(), got["hash"].to_numpy()
    order = np.lexsort((*x.T, hash_)) if len(x) else np.empty(0, np.int64)  # results don't depend on the order rows arrive in
    positive, unlabelled = (x[order][label[order] == k] for k in (1, 0))
    return fit(positive, unlabelled, class_prior(positive, unlabelled) if prior is None else prior)


def _scores(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    return _sigmoid(expand(x, model["mid"], model["wide"]) @ model["weights"])


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` from 0 to 1.

    A null text is scored as an empty one; equal rows get equal scores; an older
    column ``score`` gives way, and so does one called ``__text``; an empty table
    gives an empty result. A text of any length is scored whole, alone in a slice.
    """
    kept = [c for c in docs.columns if c != text_col and c.lower() not in ("score", "__text")]
    rows = docs.select(*kept, F.col(text_col).alias("__text"))

    def by(x: np.ndarray) -> pa.Array:
        return pa.array(_scores(x, model))

    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_figure_batches("score", by, *kept), schema)


def filter_quality(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` at least, with all their columns; a text passes through a task once. Odd rows: see ``score``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index(text_col))
            for i, j in A.slices(text, SLICE):
                x = figures(*A.texts_of(text.slice(i, j - i)))
                yield batch.slice(i, j - i).filter(pa.array(_scores(x, model) >= least))

    return docs.mapInArrow(run, docs.schema)

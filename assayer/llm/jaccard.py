"""Similarity join on word n-grams: MinHash bands, Bayesian pruning, exact check.

1. Texts with the same set of ``words``-word shingles are one class; the row with
   its smallest id (then text hash) stands for it, so exact copies cost one row.
2. Each class gets ``BANDS`` x ``ROWS`` MinHash values. Classes that share a band
   meet in the band's bucket; buckets with the same members count once. A bucket is
   cut into blocks of ``MEMBERS`` rows, and each pair of blocks is one tile. There,
   pairs that aren't connected yet are compared on growing prefixes of their MinHash
   values (a byte each) and dropped once the posterior probability of reaching the
   threshold falls below ``TOLERANCE``. A tile sends a forest of the rest, never
   its pairs.
3. Connected forests make clusters, so a chance meeting in a band, as of texts of
   similarity 0.3, links nothing. A cluster is cut into blocks, and each pair of
   blocks is one task's tile. There, the same pruning goes over all pairs, and the
   rest are verified on their whole shingle sets, which sit in the tile. Again a
   tile sends counts and a spanning forest.
4. The forests' connected components are the near-duplicate classes.

A pair at the threshold shares no band with probability below 3e-6, and is
pruned with probability of about ``TOLERANCE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import arrays as A
from assayer.llm.shared import free_name, keep

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
TOLERANCE = 1e-7
#: MinHash values compared between two looks at the posterior.
STEP = 32
#: Rows and shingles of a cluster's block, at most about; a tile holds two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Rows of a bucket's block (160 bytes each), at most about.
MEMBERS = 4096
_odd = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, flat, and where each text's begin. A shorter text is one shingle."""
    w = A.words_of(*A.texts_of(text))
    h, n = A.word_hashes(w), np.diff(w.first)
    at = np.flatnonzero(A.whole(w.doc, words))
    s, doc = A.rolling(h, words)[at], w.doc[at]
    short = np.flatnonzero((n > 0) & (n < words))
    few = np.array([A.mix(np.array([sum(int(x) * (2 * k + 3) for k, x in enumerate(h[w.first[d] : w.first[d + 1]])) & (1 << 64) - 1], np.uint64), 9)[0] for d in short], np.uint64)
    s, doc = np.r_[s, few], np.r_[doc, short]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.empty(0, bool)
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32-bit MinHash values of the sets, a row each; sets must not be empty."""
    out = np.empty((len(first) - 1, len(_odd)), np.uint32)
    for i, a in enumerate(_odd):
        out[:, i] = np.minimum.reduceat(s * a, first[:-1]) >> np.uint64(32)
    return out


def _signed(words: int):
    """Key of the shingle set, bands and low bytes of the MinHash values of each text; null if it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for i, j in A.slices(text):
                s, first = shingle_sets(text.slice(i, j - i), words)
                some = np.flatnonzero(np.diff(first))
                keys, bands, marks = [None] * (j - i), [None] * (j - i), [None] * (j - i)
                if len(some):
                    sig = signatures(s, np.r_[first[some], len(s)])
                    low = (sig & np.uint32(0xFF)).astype(np.uint8)
                    hashes = np.stack([A.rolling(np.ascontiguousarray(sig[:, b * ROWS : (b + 1) * ROWS]).reshape(-1).astype(np.uint64), ROWS, b)[::ROWS] for b in range(BANDS)], 1).astype("<u8")
                    for k, d in enumerate(some.tolist()):
                        keys[d], bands[d], marks[d] = blake2b(s[first[d] : first[d + 1]].tobytes(), digest_size=16).digest(), hashes[k].view(np.int64), low[k].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(keys, pa.binary()), pa.array(np.diff(first)), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["id", "copy", "key", "size", "bands", "mark"])

    return run


def _sets(words: int, kept: list[str]):
    """Adds the shingle set and the MinHash values to rows whose first column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for i, j in A.slices(text):
                s, first = shingle_sets(text.slice(i, j - i), words)
                sig = signatures(s, first)
                sets = [s[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + k).slice(i, j - i) for k in range(len(kept))), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=[*kept, "set", "sig"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every end of ``edges`` (``a``, ``b``; longs).

    Each round merges every node into the neighbour that ranks first by a hash
    of the round, so that the graph shrinks by a fraction a round whatever its
    shape. Edges and merges are written to the shared folder between rounds.
    """
    left, merges = keep(edges.where("a <> b").select("a", "b").distinct(), f"{name}_edges"), []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(merges))).alias("r"), F.col(c).alias("n"))
        both = left.select(F.col("a").alias("node"), "b").unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("b")))
        first = both.groupBy("node").agg(F.min(rank("b")).alias("near"))
        merges.append(keep(first.select("node", F.when(rank("node") < F.col("near"), F.col("node")).otherwise(F.col("near.n")).alias("to")), f"{name}_merges"))
        a, b = (merges[-1].select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        left = keep(left.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), f"{name}_edges")
    if not merges:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = merges[0]
    for m in merges[1:]:
        out = out.join(m.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    out = keep(out, name)
    return out.join(out.groupBy("to").agg(F.min("node").alias("root")), "to").select("node", "root")


@cache
def least_matches(threshold: float, tolerance: float, step: int = STEP, total: int = BANDS * ROWS) -> tuple[tuple[int, int], ...]:
    """For each prefix length, the fewest equal values at which a pair stays.

    The posterior of the similarity after m of n equal values, from a uniform
    prior, is Beta(m + 1, n - m + 1); its tail above the threshold is the
    probability of at most m successes in n + 1 trials at the threshold.
    """
    from math import exp, lgamma, log

    out = []
    for n in range(step, total + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            k, t = m, n + 1
            tail += exp(lgamma(t + 1) - lgamma(k + 1) - lgamma(t - k + 1) + k * log(threshold) + (t - k) * log(1 - threshold)) if threshold < 1 else float(k == t)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def _link(threshold: float, tolerance: float):
    """Forests of the pairs of each bucket's tile that aren't pruned; batches are sorted by tile."""
    looks = least_matches(threshold, tolerance)
    total = BANDS * ROWS

    def alike(mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pairs of rows ``a`` and ``b`` that stay through all looks."""
        at, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
        for n, least in looks:
            equal = equal + (mark[a[at], done:n] == mark[b[at], done:n]).sum(1)
            stay = equal >= least
            at, equal, done = at[stay], equal[stay], n
        return at

    def forest(node: np.ndarray, block: np.ndarray, mark: np.ndarray, left: int, right: int) -> list[tuple[np.ndarray, np.ndarray]]:
        label, out = np.arange(len(node)), []
        of_right = np.flatnonzero(block == right)
        for i in np.flatnonzero(block == left).tolist():
            js = of_right[of_right > i] if left == right else of_right
            js = js[label[js] != label[i]]
            if not len(js):
                continue
            js = js[alike(mark, np.full(len(js), i), js)]
            if len(js):
                _, some = np.unique(label[js], return_index=True)
                out.append((np.full(len(some), node[i]), node[js[some]]))
                label[np.isin(label, label[js])] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def work(rows: pa.Table) -> pa.RecordBatch:
            node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
            mark = np.frombuffer(b"".join(rows["mark"].to_pylist()), np.uint8).reshape(-1, total)
            tile = np.stack([rows[c].to_numpy() for c in ("bucket", "x", "y")], 1)
            first = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(1)])
            size = np.diff(np.r_[first, len(node)])
            out = []
            # the first row of each tile against the others, all tiles at once; most tiles are done then
            simple = (tile[first, 1] == tile[first, 2]) & (size > 1)
            rest = np.concatenate([np.arange(a + 1, a + n) for a, n in zip(first[simple].tolist(), size[simple].tolist(), strict=True)]) if simple.any() else np.empty(0, np.int64)
            head = np.repeat(first[simple], size[simple] - 1)
            stay = alike(mark, head, rest)
            joined = np.bincount(head[stay], minlength=len(node))[first]
            whole = simple & (joined == size - 1)
            done = np.zeros(len(node), bool)
            done[first[whole]] = True
            easy = stay[done[head[stay]]]
            out.append((node[head[easy]], node[rest[easy]]))
            for a, n, x, y in zip(first[~whole].tolist(), size[~whole].tolist(), tile[first[~whole], 1].tolist(), tile[first[~whole], 2].tolist(), strict=True):
                out += forest(node[a : a + n], block[a : a + n], mark[a : a + n], x, y)
            a, b = (np.concatenate([p[k] for p in out]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # what belongs to a tile that may go on in the next batch is held back
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bucket", "x", "y")], 1)
            others = np.flatnonzero((keys != keys[-1]).any(1))
            cut = int(others[-1]) + 1 if len(others) else 0
            if held and (cut or (keys[0] != last).any()):
                held.append(pa.Table.from_batches([batch.slice(0, cut)]))
                yield work(pa.concat_tables(held))
                held = []
            elif cut:
                yield work(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(pa.Table.from_batches([batch.slice(cut)]))
            last = keys[-1]
        if held:
            yield work(pa.concat_tables(held))

    return run


def _tile(threshold: float, tolerance: float):
    looks = least_matches(threshold, tolerance)

    def tile(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        node = rows["node"].to_numpy()  # equal rows of a text come more than once
        _, order = np.unique(node, return_index=True)
        node, block = node[order], rows["block"].to_numpy()[order]
        blobs, marks = rows["set"].to_pylist(), rows["sig"].to_pylist()
        sig = np.stack([np.frombuffer(marks[k], np.uint32) for k in order])
        sets = [np.frombuffer(blobs[k], np.uint64) for k in order]
        size = np.array([len(x) for x in sets])
        first = np.r_[0, np.cumsum(size)]
        seen, local = np.unique(np.concatenate(sets), return_inverse=True)
        local, mark = local.astype(np.int32), np.zeros(len(seen), bool)
        lists = [local[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        left_block, right_block = key[1].as_py(), key[2].as_py()
        right = np.flatnonzero(block == right_block)
        links, root = np.zeros(len(node), np.int64), list(range(len(node)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in np.flatnonzero(block == left_block).tolist():
            js = right[right > i] if left_block == right_block else right
            small, large = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
            js = js[small >= threshold * large - 1e-9]
            equal, done = np.zeros(len(js), np.int64), 0
            for n, least in looks:
                if not len(js):
                    break
                equal += (sig[js, done:n] == sig[i, done:n]).sum(1)
                stay = equal >= least
                js, equal, done = js[stay], equal[stay], n
            if len(js):
                mark[lists[i]] = True
                hit = np.r_[0, np.cumsum(mark[np.concatenate([lists[j] for j in js.tolist()])])]
                mark[lists[i]] = False
                ends = np.cumsum(size[js])
                both = hit[ends] - hit[ends - size[js]]
                js = js[both >= threshold * (size[i] + size[js] - both) - 1e-9]
                links[i] += len(js)
                links[js] += 1
                for j in js.tolist():
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        at = np.flatnonzero(links)
        return pa.table({"node": node[at], "links": links[at], "root": node[[find(x) for x in at.tolist()]] if len(at) else node[:0]})

    return tile


def _tiles(blocks: str) -> Column:
    """The tiles ``x`` <= ``y`` that a row of ``block`` among ``blocks`` belongs to."""
    return F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(F.least(o, "block").alias("x"), F.greatest(o, "block").alias("y")))


def _classes(rows: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """``id`` and ``copy`` of every row (``id``, ``copy``, ``text``), ``rep`` (least id of its shingle set), ``first`` (``id`` and ``copy`` of its class's first row) and ``n_links``."""
    signed = keep(rows.mapInArrow(_signed(words), "id long, copy long, key binary, size long, bands array<long>, mark binary"), "signed")
    # a shingle set goes by a number made from its key, so rows of one id with different texts stay apart
    head = F.min(F.struct("id", "copy", "bands", "mark")).alias("head")
    heads = signed.where(F.col("key").isNotNull()).groupBy("key").agg(head, F.max("size").alias("size"))
    heads = keep(heads.select(F.xxhash64("key").alias("node"), "key", "size", "head.*"), "heads")
    banded = heads.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("hash"))
    buckets = banded.groupBy("hash").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    buckets = buckets.select("hash", "n", F.xxhash64("n", "least", "all").alias("bucket"))
    members = banded.join(buckets, "hash").select("bucket", "node", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")).distinct()
    members = members.join(heads.select("node", "mark"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiled = members.withColumn("tile", F.explode(_tiles("blocks"))).select("bucket", "tile.x", "tile.y", "block", "node", "mark")
    edges = tiled.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node").mapInArrow(_link(threshold, tolerance), "a long, b long")
    clusters = components(edges, "clusters").join(heads.select("node", "id", "copy", "size"), "node")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = clusters.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    kept = ["node", "root", "block", "blocks"]
    texts = rows.join(placed, ["id", "copy"]).dropDuplicates(["id", "copy"]).select("text", *kept)
    sets = texts.mapInArrow(_sets(words, kept), "node long, root long, block int, blocks int, set binary, sig binary")
    tiled = sets.withColumn("tile", F.explode(_tiles("blocks"))).select("node", "set", "sig", "block", "root", "tile.x", "tile.y")
    linked = keep(tiled.groupBy("root", "x", "y").applyInArrow(_tile(threshold, tolerance), "node long, links long, root long"), "links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    found = counts.join(classes, "node").join(heads.select("node", F.struct("id", "copy").alias("own")), "node")
    found = found.join(found.groupBy("root").agg(F.min("own").alias("first")), "root").select("node", "n_links", "first")
    own = F.struct("id", "copy")
    of_key = heads.join(found, "node", "left").select("key", F.col("id").alias("rep"), F.coalesce("first", own).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # texts without words have no class: each goes by a key of its own, so they don't meet under one null
    key = lambda: F.coalesce("key", F.encode(F.concat(F.lit("no words: "), F.col("id"), F.lit("/"), F.col("copy")), "utf-8"))
    out = signed.select("id", "copy", key().alias("key")).join(of_key, "key", "left")
    return out.select("id", "copy", F.coalesce("rep", "id").alias("rep"), F.coalesce("first", own).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The near-duplicate class of every row, and its number of links.

    Returns, for each row of ``docs``, ``node`` (its id), ``copy`` (a hash of the
    text), ``rep`` (least id of the rows with the same shingle set), ``class_id`` (least
    ``rep`` of the connected class) and ``n_links`` (other shingle sets of
    similarity ``threshold`` or more). Words are cut at ASCII white space and
    compared as they are. Texts without words, nulls included, are alone:
    ``rep`` and ``class_id`` are their own id, no links. Rows with a null id take
    part under a negative number made from their text. Equal rows stay and share
    a class; different texts under one id are classes of their own. Ties of ids go
    to the least text hash. An empty table gives an empty result; other columns
    are not read, so their names don't matter. Very long texts are read whole: a
    task holds one at a time, at about 100 bytes a word.
    """
    rows = docs.select(_node(id_col, text_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    out = _classes(rows, words, threshold, tolerance)
    return out.select(F.col("id").alias("node"), "copy", "rep", F.col("first.id").alias("class_id"), "n_links")


def _node(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), -1 - F.abs(F.xxhash64(text_col) % (1 << 62)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate class of ``docs``, the one with the least id, then text hash, with its columns.

    Rows equal in id and text count once. Texts without words all stay. Columns may have any names.
    """
    rows = docs.select(_node(id_col, text_col).alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    found = _classes(rows, words, threshold, TOLERANCE)
    stay = found.where(F.struct("id", "copy") == F.col("first")).groupBy("id", "copy").agg(F.count("*").alias("n"))
    node, copy = free_name(docs, "__node"), free_name(docs, "__copy")
    stay = keep(stay.select(F.col("id").alias(node), F.col("copy").alias(copy), "n"), "stay")
    out = docs.join(stay.select(node, copy), (_node(id_col, text_col) == F.col(node)) & (F.xxhash64(text_col) == F.col(copy)), "left_semi")
    return out if stay.where("n > 1").isEmpty() else out.dropDuplicates([id_col, text_col])

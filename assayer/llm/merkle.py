"""Merkle manifest of a dataset: mountain ranges of sorted runs, merged across tasks.

Rows of a group are leaves in order. Every ``fanout`` consecutive nodes of a level
(the last run of a level may have fewer, even one) become their hash on the next,
until one node remains; the roots of the groups, in order of the groups, are the
leaves of a last tree of the same kind. Nothing is ever padded.

Rows are sorted by range, so a group of any size is spread over many tasks, and
cut into runs of one Arrow batch each. A run knows the place of its first leaf
from sums of run lengths. It pushes its leaves on a stack of peaks: a run of
siblings that ends is popped and its hash is carried to the next level. What
stays (siblings that begin in an earlier run or end in a later one) are peaks, a
few a level. Peaks of ``MERGED`` neighbouring runs meet in the same stack, and
again, until a group has one node; so no task holds more than a few peaks of
``MERGED`` runs. For proofs, a run looks up the few nodes beside its edges by an
equi-join and makes all others again from its own leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.shared import bounded_batches, keep

#: Runs whose peaks meet in one row of a merge.
MERGED = 64
#: Runs whose places are summed in one window.
BLOCK = 1024
_NODES = "array<struct<level: int, pos: bigint, digest: string>>"
_PUSHED = f"g string, pid int, chunk long, ord long, first long, n long, nodes {_NODES}, wants array<struct<level: int, pos: bigint>>"
_ONE_NODE = pa.struct([("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string())])
_KEYS = ["g", "pid", "chunk"]


def digest_of(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of values side by side: a null as ``-``, else its UTF-8 bytes behind their count and ``:``."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]).cast("binary"), 256)


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def widths(n: int, fanout: int) -> list[int]:
    """Number of nodes of each level above ``n`` leaves, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """Peaks of a stretch of a tree of ``n`` leaves, a stack a level; nodes are pushed in the order of their leaves."""

    def __init__(self, n: int, fanout: int) -> None:
        self.widths, self.fanout = widths(n, fanout), fanout
        self.stacks: list[list[tuple[int, str]]] = [[] for _ in self.widths]
        self.made: list[tuple[int, int, str]] = []

    def push(self, level: int, pos: int, digest: str) -> None:
        while True:
            stack = self.stacks[level]
            stack.append((pos, digest))
            if level + 1 == len(self.widths):
                return
            start = pos - pos % self.fanout
            size = pos + 1 - start
            if size < min(self.fanout, self.widths[level] - start):
                return  # siblings are still to come
            if len(stack) < size or stack[-size][0] != start:
                return  # the first of them lie in an earlier stretch
            digest = _hash([d for _, d in stack[-size:]])
            del stack[-size:]
            level, pos = level + 1, start // self.fanout
            self.made.append((level, pos, digest))

    def peaks(self) -> list[tuple[int, int, str]]:
        """What waits for siblings, in the order of leaves."""
        out = [(level, pos, d) for level, stack in enumerate(self.stacks) for pos, d in stack]
        return sorted(out, key=lambda x: x[1] * self.fanout ** x[0])


def needed(first: int, past: int, n: int, fanout: int) -> list[tuple[int, int]]:
    """Level and place of the nodes in proofs of leaves ``first`` to ``past`` that these leaves alone can't make."""
    out = []
    for level, wide in enumerate(widths(n, fanout)[:-1]):
        span = fanout**level
        low, high = first // span, (past - 1) // span
        for pos in range(low - low % fanout, min(high - high % fanout + fanout, wide)):
            if pos * span < first or min((pos + 1) * span, n) > past:
                out.append((level, pos))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of a group in a batch: their list, and its number within the task."""
    task, chunk = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not len(batch):
            continue
        g = batch.column(0)
        names = g.to_pylist()
        cuts = np.array([0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)], np.int32)
        rows = pa.StructArray.from_arrays(batch.columns[1:], names=["id", "leaf", *batch.schema.names[3:]])
        n = len(cuts) - 1
        numbers = pa.array(np.arange(chunk, chunk + n), pa.int64())
        yield pa.RecordBatch.from_arrays([g.take(pa.array(cuts[:-1])), pa.array([task] * n, pa.int32()), numbers, pa.ListArray.from_arrays(cuts, rows)], names=["g", "pid", "chunk", "rows"])
        chunk += n


def _pushed(fanout: int, records: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Peaks of each run, with the nodes that its proofs need from others; or, as ``records``, every node made in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, wants = [], []
            for first, n, leaves in zip(batch["first"].to_pylist(), batch["n"].to_pylist(), batch["leaves"]):
                stack = Range(n, fanout)
                for k, leaf in enumerate(leaves.as_py()):
                    stack.push(0, first + k, leaf)
                nodes.append([dict(zip(("level", "pos", "digest"), x)) for x in (stack.made if records else stack.peaks())])
                wants.append([{"level": level, "pos": pos} for level, pos in needed(first, first + len(leaves), n, fanout)])
            kept = [batch[c] for c in (*_KEYS, "ord", "first", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.list_(_ONE_NODE)), pa.array(wants, pa.list_(pa.struct([("level", pa.int32()), ("pos", pa.int64())])))], names=[*_KEYS, "ord", "first", "n", "nodes", "wants"])

    return run


def _merged(fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Peaks of neighbouring runs, met in one stack: what remains, and what was made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, made = [], []
            for n, parts in zip(batch["n"].to_pylist(), batch["parts"]):
                stack = Range(n, fanout)
                for part in sorted(parts.as_py(), key=lambda p: p["ord"]):
                    for x in part["nodes"]:
                        stack.push(x["level"], x["pos"], x["digest"])
                for out, found in ((nodes, stack.peaks()), (made, stack.made)):
                    out.append([dict(zip(("level", "pos", "digest"), x)) for x in found])
            yield pa.RecordBatch.from_arrays([batch["g"], batch["n"], batch["ord"], pa.array(nodes, pa.list_(_ONE_NODE)), pa.array(made, pa.list_(_ONE_NODE))], names=["g", "n", "ord", "nodes", "made"])

    return run


def _proved(fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each run the steps from each of its leaves to the root of its group."""
    step = pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for first, n, leaves, beside in zip(batch["first"].to_pylist(), batch["n"].to_pylist(), batch["leaves"], batch["beside"]):
                leaves, stack = leaves.as_py(), Range(n, fanout)
                nodes = {(x["level"], x["pos"]): x["digest"] for x in beside.as_py() or []}
                for k, leaf in enumerate(leaves):
                    nodes[0, first + k] = leaf
                    stack.push(0, first + k, leaf)
                nodes.update({(level, pos): d for level, pos, d in stack.made})
                at, others, which, past = [], [], [], first + len(leaves)
                for level, wide in enumerate(stack.widths[:-1]):
                    low, high, base = first // fanout**level, (past - 1) // fanout**level, len(at)
                    for pos in range(low, high + 1):
                        start = pos - pos % fanout
                        at.append(pos - start)
                        others.append([nodes[level, q] for q in range(start, min(start + fanout, wide)) if q != pos])
                    which.append(base + np.arange(first, past) // fanout**level - low)
                steps = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(others, pa.list_(pa.string()))], names=["at", "others"])
                order = np.stack(which, 1).reshape(-1) if which else np.empty(0, np.int64)
                paths.append(pa.ListArray.from_arrays(np.arange(len(leaves) + 1, dtype=np.int32) * len(which), steps.take(pa.array(order)).cast(step)))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, paths)]).astype(np.int32), pa.concat_arrays(paths)) if paths else pa.array([], pa.list_(pa.list_(step)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("g", "first", "n", "rows")), lists], names=["g", "first", "n", "rows", "steps"])

    return run


@dataclass
class Tree:
    """Trees of all groups: ``runs`` of rows, where each lies (``peaks``), the ``shared`` nodes that cross runs, and the ``roots``."""

    runs: DataFrame
    peaks: DataFrame
    shared: DataFrame
    roots: DataFrame
    fanout: int

    def nodes(self) -> DataFrame:
        """Every node above the leaves: ``g``, ``level`` (leaves are 0), ``pos`` and ``digest``."""
        inner = _placed(self.runs, self.peaks).mapInArrow(_pushed(self.fanout, True), _PUSHED)
        made = inner.select("g", F.explode("nodes").alias("x")).select("g", "x.*")
        return made.unionByName(self.shared.where("crossing").drop("crossing"))

    def proofs(self) -> DataFrame:
        """Each row with the place of its leaf, the number of leaves of its group, and ``steps`` to the root of its group.

        A step has ``others``, the siblings in order, and ``at``, how many of them stand before the node itself.
        """
        wants = self.peaks.select(*_KEYS, F.explode("wants").alias("w")).select(*_KEYS, "w.*")
        beside = wants.join(self.shared, ["g", "level", "pos"]).groupBy(*_KEYS).agg(F.collect_list(F.struct("level", "pos", "digest")).alias("beside"))
        placed = self.peaks.select(*_KEYS, "ord", "first", "n").join(beside, _KEYS, "left")
        rows = self.runs.join(placed, _KEYS).select("*", F.col("rows.leaf").alias("leaves"))
        step = "array<struct<at: int, others: array<string>>>"
        out = rows.mapInArrow(_proved(self.fanout), f"g string, first long, n long, rows {self.runs.schema['rows'].dataType.simpleString()}, steps array<{step}>")
        each = F.posexplode(F.arrays_zip("rows", "steps")).alias("k", "x")
        return out.select("g", "first", "n", each).select("g", (F.col("first") + F.col("k")).alias("pos"), "n", "x.rows.*", "x.steps")


def _placed(runs: DataFrame, places: DataFrame) -> DataFrame:
    return runs.select(*_KEYS, F.col("rows.leaf").alias("leaves")).join(places.select(*_KEYS, "ord", "first", "n"), _KEYS)


def build(rows: DataFrame, fanout: int = 2) -> Tree:
    """Trees of ``rows``: ``g`` (group, a string, never null), ``id``, ``leaf`` (a digest), and columns that are carried along.

    Leaves of a group ascend by id, null first; equal ids by digest. Equal rows are
    leaves each; the order among them changes nothing. No rows give no trees.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of 2 or more")
    bounded_batches(rows.sparkSession)
    carried = [c for c in rows.columns if c not in ("g", "id", "leaf")]
    # written first: sorting by range reads its input twice, and rows that are equal are told apart by their place in it
    leaves = keep(rows.select("g", "id", "leaf", *carried), "merkle-leaves").withColumn("tie", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("g", "id", "leaf", "tie")]
    kinds = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in ("id", "leaf", *carried))
    in_order = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("g", "id", "leaf", *carried)
    runs = keep(in_order.mapInArrow(_runs, f"g string, pid int, chunk long, rows array<struct<{kinds}>>"), "merkle-runs")
    sizes = runs.select(*_KEYS, F.floor(F.col("pid") / BLOCK).alias("block"), F.size("rows").cast("long").alias("size"))
    within = Window.partitionBy("g", "block").orderBy("pid", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("g", "block").agg(F.sum("size").alias("size"), F.count("*").alias("runs"))
    blocks = blocks.select("g", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("size", "runs")], F.sum("size").over(Window.partitionBy("g")).alias("n"))
    in_block = sizes.select(*_KEYS, "block", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("size"), F.count("size").over(within).alias("runs"))
    places = in_block.join(blocks, ["g", "block"]).select(*_KEYS, (F.col("runs") + F.col("runs_before")).alias("ord"), (F.col("size") + F.col("size_before")).alias("first"), "n")
    peaks = keep(_placed(runs, places).mapInArrow(_pushed(fanout, False), _PUSHED), "merkle-peaks")
    most = peaks.agg(F.max("ord")).first()[0] or 0
    left, nodes = peaks.select("g", "n", "ord", "nodes"), peaks.select("g", F.explode("nodes").alias("x"), F.lit(False).alias("crossing"))
    while most:
        most //= MERGED
        met = left.groupBy("g", "n", F.floor(F.col("ord") / MERGED).alias("to")).agg(F.collect_list(F.struct("ord", "nodes")).alias("parts"))
        done = keep(met.select("g", "n", F.col("to").alias("ord"), "parts").mapInArrow(_merged(fanout), f"g string, n long, ord long, nodes {_NODES}, made {_NODES}"), "merkle-merged")
        left, nodes = done.select("g", "n", "ord", "nodes"), nodes.unionByName(done.select("g", F.explode("made").alias("x"), F.lit(True).alias("crossing")))
    roots = left.select("g", F.col("nodes")[0]["digest"].alias("root"), "n")
    return Tree(runs, peaks, nodes.select("g", "x.*", "crossing"), roots, fanout)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""

    def up(h: Column, s: Column) -> Column:
        before, after = F.slice(s["others"], F.lit(1), s["at"]), F.slice(s["others"], s["at"] + 1, F.size(s["others"]))
        return F.sha2(F.concat(F.array_join(before, ""), h, F.array_join(after, "")).cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


def manifest(docs: DataFrame, columns: Sequence[str], group_col: str, id_col: str, fanout: int = 2, carried: dict[str, Column] | None = None) -> tuple[Tree, Tree]:
    """Trees of all groups of ``docs`` and the tree over their roots.

    A leaf is ``digest_of`` the ``columns``. Groups are values of ``group_col`` as
    strings, null first, then by their UTF-8 bytes. ``carried`` columns go along
    with each leaf. Other columns aren't read, whatever their names. A null id comes
    first in its group; equal ids are in the order of their leaves, equal rows are
    leaves each. A text of any length is hashed whole; a group of any size is spread
    over tasks. An empty table has neither groups nor a root.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    trees = build(docs.select(g.alias("g"), F.col(id_col).alias("id"), digest_of([F.col(c) for c in columns]).alias("leaf"), *[c.alias(name) for name, c in (carried or {}).items()]), fanout)
    top = build(trees.roots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("root").alias("leaf")), fanout)
    return trees, top


def proofs(trees: Tree, top: Tree) -> DataFrame:
    """Every leaf with ``subroot``, ``root`` and all ``steps`` from the leaf to the root; carried columns stay.

    ``g`` is the group behind a ``=``, empty for null. A table has one root, so it is attached to the few rows of groups.
    """
    over = top.proofs().join(top.roots.select("g", "root"), "g").select(F.col("id").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("steps").alias("over"))
    return trees.proofs().join(over, "g").withColumn("steps", F.concat("steps", "over")).drop("over")

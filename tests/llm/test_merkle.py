"""The Merkle manifest against a plain recursion, with runs of a few rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from assayer.llm import merkle, queries
from llm_brute import SF, rows

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, id int, steps string, pid int"


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_of(row):
    said = [None if v is None else str(v) for v in row[:5]]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in said))


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(tree, pos, fanout):
    for level in tree[:-1]:
        start = pos - pos % fanout
        yield pos - start, [level[q] for q in range(start, min(start + fanout, len(level))) if q != pos]
        pos //= fanout


def by_hand(data, fanout):
    """Leaf, subroot, root and all steps of each row, as a sorted list."""
    groups = {}
    for r in data:
        groups.setdefault("" if r[2] is None else f"={r[2]}", []).append(((r[0] is not None, r[0] or 0, leaf_of(r)), r))
    names = sorted(groups, key=str.encode)
    trees = {g: levels([leaf for (_, _, leaf), _ in sorted(groups[g], key=lambda x: x[0])], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for pos, ((_, _, leaf), r) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], [*steps(trees[g], pos, fanout), *steps(top, k, fanout)]))
    return sorted(out, key=repr)


@pytest.fixture
def short_runs(spark):
    """Runs of three rows, merged four at a time, in blocks of two tasks."""
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", (merkle.MERGED, merkle.BLOCK)
    was = spark.conf.get(name, None)
    spark.conf.set(name, "3")
    merkle.MERGED, merkle.BLOCK = 4, 2
    yield
    merkle.MERGED, merkle.BLOCK = before
    spark.conf.set(name, was) if was else spark.conf.unset(name)


def built(df, fanout):
    trees, top = merkle.manifest(df, COLUMNS, "lang", "doc_id", fanout)
    got = merkle.proofs(trees, top).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert all(r["folded"] == r["root"] for r in got)
    return sorted(((r["id"], r["leaf"], r["subroot"], r["root"], [(s["at"], list(s["others"])) for s in r["steps"]]) for r in got), key=repr), trees


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_proofs_of_groups_of_many_sizes(spark, short_runs, fanout):
    data = []
    for lang, n in (("a", 1), ("b", 2), ("é", 3), (None, 7), ("d", 61), ("", 10)):
        data += [(i, "s", lang, None if i % 5 == 0 else i, f"text {lang} {i}", "x", "y", 1, "z", 2) for i in range(n)]
    got, trees = built(spark.createDataFrame(data, SCHEMA), fanout)
    assert got == by_hand(data, fanout)
    inner = [(r["g"], r["level"], r["pos"], r["digest"]) for r in trees.nodes().collect()]
    expected = []
    for g in {r[2] for r in data}:
        tree = levels([leaf_of(r) for r in sorted(x for x in data if x[2] == g)], fanout)
        expected += [("" if g is None else f"={g}", k, p, d) for k, level in enumerate(tree) for p, d in enumerate(level) if k]
    assert sorted(inner) == sorted(expected)


def test_odd_rows(spark, short_runs):
    odd = [(None, None, None, None, None), (None, None, None, None, None), (None, None, None, None, ""), (3, "s", "en", 1, "é" * 40_000), (3, "s", "en", 1, "é" * 40_000), (3, "s", "en", 2, "other"), (-4, "", "en", -7, " ")] + [(9, "s", "en", 1, "same")] * 20
    data = [(*r, "x", "y", 1, "z", 2) for r in odd]
    df = spark.createDataFrame(data, SCHEMA)
    assert built(df, 2)[0] == by_hand(data, 2)
    assert built(df.limit(0), 2)[0] == []
    one = built(df.where("doc_id = -4"), 2)[0]
    assert one == [(-4, leaf_of(odd[-21]), leaf_of(odd[-21]), leaf_of(odd[-21]), [])]
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame([], "g string, id int, leaf string"), 1)


def test_stack_needs_no_order_of_tasks():
    """Peaks of any cut of a sequence meet in the same root, and needed nodes are just those that a stretch can't make."""
    leaves = [h(str(i)) for i in range(53)]
    for fanout in (2, 3, 4):
        tree = levels(leaves, fanout)
        for cuts in ([0, 53], [0, 1, 53], [0, 17, 18, 40, 53], list(range(54))):
            met = merkle.Range(53, fanout)
            for a, b in zip(cuts, cuts[1:]):
                part = merkle.Range(53, fanout)
                for i in range(a, b):
                    part.push(0, i, leaves[i])
                own = {(x[0], x[1]) for x in part.made} | {(0, i) for i in range(a, b)}
                assert not own & set(merkle.needed(a, b, 53, fanout))
                for node in part.peaks():
                    met.push(*node)
            assert [d for _, _, d in met.peaks()] == tree[-1]


def test_query_finds_what_was_tampered_with(spark):
    got = {r["doc_id"]: r for r in queries.op12_merkle_manifest(spark, SF).collect()}
    data = [tuple(r[c] for c in COLUMNS) for r in rows("documents", *COLUMNS)]
    expected = {x[0]: x for x in by_hand(data, 2)}
    assert set(got) == set(expected)
    for i, (_, leaf, subroot, root, path) in expected.items():
        r = got[i]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (leaf, subroot, root, h(*(d for _, others in path for d in others)))
        assert r["verified"] == (zlib.crc32(str(i).encode()) % 7 != 0) == (r["folded_root"] == root)

"""Plain versions of operators that several tests compare with."""

import re
import zlib

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.01"


def rows(name, *columns):
    return pq.read_table(f"{SF}/{name}.parquet", columns=list(columns) or None).to_pylist()


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def classes_by_brute_force(texts, n=5, threshold=0.8):
    """Least index of each text's class, and its number of links, from all pairs that share a shingle."""
    sets = []
    for t in texts:
        ws = words(t)
        sets.append({tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set())
    root, links = list(range(len(texts))), {}
    by = {}
    for i, s in enumerate(sets):
        if s:
            by.setdefault(frozenset(s), []).append(i)
    find = lambda x: x if root[x] == x else find(root[x])
    keys = list(by)
    where = {}
    for k, s in enumerate(keys):
        for g in s:
            where.setdefault(g, []).append(k)
    for k, s in enumerate(keys):
        for m in by[s]:
            root[find(m)] = min(find(m), find(by[s][0]))
        met = {}
        for g in s:
            for o in where[g]:
                met[o] = met.get(o, 0) + 1
        for o, both in met.items():
            if o != k and both >= threshold * (len(s) + len(keys[o]) - both) - 1e-9:
                links[k] = links.get(k, 0) + 1
                a, b = find(by[s][0]), find(by[keys[o]][0])
                root[max(a, b)] = min(a, b)
    count = {i: links.get(k, 0) for k, s in enumerate(keys) for i in by[s]}
    return {i: (find(i), count.get(i, 0)) for i in range(len(texts))}


def leaks_by_brute_force(docs):
    """Items of which a document holds 13 words in a row, whatever their case and the punctuation at their ends."""
    plain = lambda t: [w.strip(".,!?;:").lower() for w in words(t)]
    grams = {}
    for r in rows("benchmark"):
        ws = plain(r["text"])
        for k in range(len(ws) - 12):
            grams.setdefault(tuple(ws[k : k + 13]), set()).add(r["item_id"])
    out = {}
    for r in docs:
        ws = plain(r["text"])
        out[r["doc_id"]] = set().union(*(grams.get(tuple(ws[k : k + 13]), set()) for k in range(len(ws) - 12)))
    return out

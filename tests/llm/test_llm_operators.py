"""The numbered operators against brute force, the tokenizers library, and odd rows."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import arrays, bpe, decontaminate, html, jaccard, language, lines, neighbours, quality, queries, substring, urls
from llm_brute import SF, classes_by_brute_force, held_out, leaks_by_brute_force, rows, words

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, `id` string, `key` int, `host` string"


def docs(spark, texts, langs=None):
    data = [(i, t, langs[i] if langs else None, "s", None, 1.0, "x", i, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, EXTRA)


ODD = [None, "", "  \n\n ", "one", "a b c d e f", "a b c d e f", "x\ny\nz\nx\ny\nz", "é" * 5000 + " " + "word " * 3000]


# 1 ---------------------------------------------------------------------------


def test_search_recall_and_scores(spark):
    got = queries.op1_inverted_multi_index(spark, SF).collect()
    data = {r["vec_id"]: r["embedding"] for r in rows("embeddings")}
    data = {i: np.array(v, np.float64) for i, v in data.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(data))
    matrix = np.stack([data[i] for i in ids])
    found, right = {}, 0
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(found) == asked
    for q in asked:
        s = matrix @ data[q]
        order = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(float(data[v] @ data[q]) - x) < 1e-12 for _, v, x in mine)
        right += len({v for _, v, _ in mine} & set(order))
    assert right / (20 * len(asked)) >= 0.9


def test_search_odd_vectors(spark):
    same = [[1.0, 2.0, 3.0, 4.0]] * 30
    odd = [None, [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [1.0, 1.0]]
    data = [(i, v, "x", 1) for i, v in enumerate(same + odd)] + [(None, same[0], "x", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id string, rank int")
    got = neighbours.nearest(df, df.where("vec_id in (0, 31, 3)"), 5).collect()
    assert [(r[0], r[1], r[2]) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (0, 5, 5), (3, 1, 0), (3, 2, 1), (3, 3, 2), (3, 4, 4), (3, 5, 5)]
    assert {r[3] for r in got} == {30.0}
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 2


def test_search_over_shards_and_blocks(spark, monkeypatch):
    """Several shards and blocks of queries, a frequent vector, and the same row twice; everything is asked, so nothing is missed."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 40)
    monkeypatch.setattr(neighbours, "LEAST_SHARD", 16)
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=6).round(3).tolist() for _ in range(150)] + [[1.0, 0.5, 0.0, 0.0, 0.5, 1.0]] * 60
    data = list(enumerate(vectors)) + [(7, vectors[7])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id <> 7"), 4, share=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    m = np.array(vectors)
    assert len(got) == len(vectors) - 1
    for q, found in got.items():
        s = (m @ m[q]).round(9)
        pairs = sorted((-s[i], i) for i, _ in data if i != q)[:4]
        assert [(v, x) for _, v, x in sorted(found)] == [(i, -x) for x, i in pairs]


def test_walk_is_by_ascending_sum():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = neighbours.walk(a, b, np.ones(35, int), 35)
    sums = [a[c // 5] + b[c % 5] for c in got]
    assert sums == sorted(sums) and len(set(got)) == 35


# 2 ---------------------------------------------------------------------------


def removed_by_brute_force(texts, n):
    seen, out = {}, []
    split = [words(t) for t in texts]
    for ws in split:
        for i in range(len(ws) - n + 1):
            w = tuple(ws[i : i + n])
            seen[w] = seen.get(w, 0) + 1
    for ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if seen[tuple(ws[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return out


@pytest.mark.parametrize("n", [2, 3, 7])
def test_repeated_passages(spark, n):
    rng = np.random.default_rng(n)
    texts = ODD + [" ".join(rng.choice(list("abcd"), rng.integers(0, 40)).tolist()) for _ in range(60)]
    got = substring.remove_repeated_passages(docs(spark, texts), min_words=n).collect()
    assert [(r["n_words"], sum(s["past"] - s["first"] for s in r["spans"]), r["kept"]) for r in sorted(got)] == removed_by_brute_force(texts, n)
    assert substring.remove_repeated_passages(docs(spark, []), min_words=n).count() == 0


def test_repeated_passages_query(spark):
    got = {r["doc_id"]: r for r in queries.op2_substring_dedup(spark, SF).collect()}
    table = rows("documents", "doc_id", "text")
    for r, (n, gone, kept) in zip(table, removed_by_brute_force([r["text"] for r in table], 35)):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_removed"], g["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_the_same_row_twice_loses_both(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text), (1, text), (2, " ".join(map(str, range(100, 140))))], "doc_id long, text string")
    got = sorted((r["id"], r["n_words"], r["kept"] == "") for r in substring.remove_repeated_passages(df).collect())
    assert got == [(1, 40, True), (1, 40, True), (2, 40, False)]


@pytest.mark.parametrize("buckets", [1, 3, 7, 1 << 24])
def test_dealing_touches_only_buckets_with_hashes(buckets):
    """Every hash goes to the one bucket of its range, whatever the number of buckets of the corpus."""
    h = np.random.default_rng(1).integers(0, 1 << 40, 3000, dtype=np.uint64)
    h = np.r_[h, h[:100]]
    block = np.arange(len(h)) % 3 == 0
    dealt = substring._deal(5, [h[:1000], h[1000:]], [block[:1000], block[1000:]], 40, buckets)
    assert len(dealt) <= min(buckets, len(h)) and all(r[1] == 5 for r in dealt)
    assert np.array_equal(np.concatenate([arrays.unpack(r[2]) for r in dealt]), np.unique(h))
    step = -(-(1 << 40) // buckets)
    assert all(int(x) // step == r[0] for r in dealt for x in arrays.unpack(r[2]))
    seen = {int(x) for x, b in zip(h, block) if b}
    flags = [(int(x), bool(f)) for r in dealt for x, f in zip(arrays.unpack(r[2]), np.unpackbits(np.frombuffer(r[3], np.uint8)))]
    assert all(f == (x in seen) for x, f in flags)
    assert substring._deal(5, [], [], 40, buckets) == []


# 3 ---------------------------------------------------------------------------


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">Cookies</div>
    <div class=ad>Buy</div><article><h1>Head &amp; tail</h1><p><b>One   two<br><p>Three&nbsp;&#233;<p>a &lt; b</p><ul><li>i<li>j</ul>
    <aside>Aside</aside><form><input value="x">Send</form><section id="comments"><p>First!</p></section><pre>x
    y</pre></article><!-- no --><footer>&copy; me</footer></body></html>"""
    data = [(1, "http://a.example/x", page, "h", 1), (2, None, None, "h", 1), (3, "", "", "h", 1), (4, "http://a.example/y", "<p>loose <b>text", "h", 1)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, host string, template int")
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    assert got == {1: "Head & tail\nOne two\nThree é\na < b\ni\nj\nx y", 2: "", 3: "", 4: "loose text"}
    assert html.extract_text(df.limit(0)).count() == 0


def test_site_templates_go(spark):
    body = "<div><div class=x>Our site since 1999</div><p>Story {0} of this page</p><p>Common line</p><div><span>Call us</span></div></div>"
    data = [(i, f"http://h.example/{i}", body.format(i)) for i in range(12)] + [(99, "http://other.example/", body.format(99))]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of this page"
    assert got[99] == "Our site since 1999\nStory 99 of this page\nCommon line\nCall us"
    copies = [(i, f"http://h.example/{i}", "<article><div><p>Same story</p></div></article>") for i in range(12)]
    got = html.extract_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Same story"}


@pytest.mark.parametrize("most", [html.BROADCAST_HASHES, 0])
def test_templates_of_sections_go(spark, monkeypatch, most):
    """Four templates, each on 6 of 25 pages of a host, without a telling tag or class; sentences stay whole."""
    monkeypatch.setattr(html, "BROADCAST_HASHES", most)
    body = "<div><div>Section {0} since 1999</div><p>Story {1} is <b>not</b> over</p><div><span>Call desk {0}</span></div></div>"
    data = [(i, f"http://h.example/{i}", body.format(i // 6, i)) for i in range(25)] + [(99, "http://other.example/", body.format(0, 99))]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is not over" for i in range(24))
    assert got[24] == "Section 4 since 1999\nStory 24 is not over\nCall desk 4"
    assert got[99] == "Section 0 since 1999\nStory 99 is not over\nCall desk 0"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_templates_with_changing_words_go(spark):
    """Menus, adverts and footers that share only their shape, on pages without an article and without telling names."""
    page = """<html><body><div class="q{0}"><a href="/{1}">Go {1}</a><a href="/x">To {1}</a>{2}</div><div class="z1">Offer number {1}, today</div>
    <div class="text"><h1>Headline {1}</h1><p>First words of story {1} that go on and on for a while.</p><p>Then {1} more, with <b>bold</b> ones.</p></div>
    <div class="z2"><span>Seen {1} times</span></div></body></html>"""
    data = [(i, f"http://h.example/{i}", page.format(i % 3, f"w{i}", "<a>More</a>" * (i % 4))) for i in range(30)]
    few = [(100 + i, f"http://few.example/{i}", page.format(0, f"w{i}", "")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, data + few)).collect()}
    for i in range(30):
        assert got[i] == f"Headline w{i}\nFirst words of story w{i} that go on and on for a while.\nThen w{i} more, with bold ones."
    assert "Offer number" in got[100]


def test_repeated_blocks_in_articles_go_only_if_most_pages_have_them(spark):
    page = "<body><article><h1>T{0}</h1><p>Story {0} is told here.</p><p>{1}</p><p>Subscribe to our daily letter</p></article></body>"
    data = [(i, f"http://h.example/{i}", page.format(i, "A quote that six share." if i < 6 else f"Own {i}.")) for i in range(16)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, data + data[:2])).collect()}
    assert got[2] == "T2\nStory 2 is told here.\nA quote that six share." and got[9] == "T9\nStory 9 is told here.\nOwn 9."


def test_site_templates_are_those_of_a_plain_count(spark):
    """Hashes of a host's subtrees counted one by one; the same row twice is one page."""
    table = rows("pages")
    df = pages(spark, [(r["page_id"], r["url"], r["html"]) for r in table] + [(table[0]["page_id"], table[0]["url"], table[0]["html"])])
    seen, hosts = {}, {}
    for r in table:
        host = re.sub(r"(?s)^.*?://([^/?#]*).*$", r"\1", r["url"]).lower()
        root = html.parse(r["html"])
        main, marked = html.main_of(root)
        text = "\n".join(html.blocks_of(main, lambda x: html.is_boilerplate(x, True)))
        hosts.setdefault(host, set()).add(text)
        for h, kind in set(zip(*(x.tolist() for x in html.template_parts(root, main, marked, host)[:2]))):
            seen.setdefault((host, h, kind), set()).add(text)
    want = {h for (host, h, kind), texts in seen.items() if len(texts) >= 5 and (kind != html.INSIDE or len(texts) >= len(hosts[host]) / 2)}
    counted = html.recurring(df)
    assert {r["hash"] % (1 << 64) for r in html.site_templates(counted).collect()} == want and len(want) > 20
    assert {r["hash"] % (1 << 64) for r in counted.where(F.col("kind") == html.HOST).collect()} == {int(html.host_key(host, html.HOST)) for host, texts in hosts.items() if len(texts) >= 5}


def test_templates_alone_give_the_same_texts(spark, monkeypatch):
    """Where names and places beside an article say nothing about what is outside it, on every page of a host with pages enough it is the templates that decide, and they give the texts that all signs give together."""
    every = {r["page_id"]: r["text"] for r in queries.op3_main_text(spark, SF).collect()}
    table = rows("pages")
    found = html.site_templates(html.recurring(pages(spark, [(r["page_id"], r["url"], r["html"]) for r in table]))).toArrow()["hash"].to_numpy()
    templates = np.sort(found.view(np.uint64))
    host = {r["page_id"]: re.sub(r"(?s)^.*?://([^/?#]*).*$", r"\1", r["url"]).lower() for r in table}
    named = html.is_boilerplate
    monkeypatch.setattr(html, "BESIDE", 0)  # in this process
    monkeypatch.setattr(html, "is_boilerplate", lambda x, inside: named(x, True) if inside else x.tag in html.DROPPED or x.tag == "header")
    whole = {r["page_id"]: html.main_text(r["html"], host[r["page_id"]], templates) for r in table}
    bare = {r["page_id"]: html.main_text(r["html"], host[r["page_id"]]) for r in table}
    hosts = {}
    for i, h in host.items():
        hosts.setdefault(h, set()).add(i)
    large = set().union(*(x for x in hosts.values() if len({every[i] for i in x}) >= 5))
    assert {i for i in whole if whole[i] != bare[i]} == large and len(large) > 100
    assert {i for i in large if whole[i] != every[i]} == set()


def test_very_long_pages(spark):
    long = "<article>" + "".join(f"<p>Para {i} of it</p>" for i in range(20_000)) + "</article>"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, [(1, "http://a.example/", long), (2, "http://a.example/2", deep)])).collect()}
    assert got[1].count("\n") == 19_999 and got[2] == "deep text"


def test_main_text_query(spark):
    got = {r["page_id"]: r for r in queries.op3_main_text(spark, SF).collect()}
    from html import unescape

    for r in rows("pages"):
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"<p>|</p>|<h1>|</h1>|<br>", inner)) if t)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


# 4 ---------------------------------------------------------------------------


def test_language_query(spark):
    got = {r["doc_id"]: r for r in queries.op4_language(spark, SF).collect()}
    table = rows("documents", "doc_id", "text", "lang")
    assert len(got) == len(table)
    held = [r for r in table if held_out(r["doc_id"])]
    assert all(got[r["doc_id"]]["held_out"] == held_out(r["doc_id"]) for r in table)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_texts(spark):
    train = docs(spark, ["der die das und nicht " * 20, "the and that with this " * 20, None, "x"], ["de", "en", "en", None])
    f = language.learn(train)
    got = {r["id"]: (r["lang_pred"], r["score"] > 0) for r in language.identify(docs(spark, ["Das und die", "THE WITH", None, "", "12 !?", "😀 —", "zzzz"]), f).collect()}
    assert got == {0: ("de", True), 1: ("en", True), 2: ("und", False), 3: ("und", False), 4: ("und", False), 5: ("und", False), 6: (f.usual, False)}
    empty = language.learn(train.limit(0))
    assert {r["lang_pred"] for r in language.identify(train, empty).collect()} == {"und"}


def test_language_by_exact_sets(spark):
    """The filters against exact sets of n-grams, learned and counted by plain loops; ties, repeated rows and a very long text."""
    words_ = {"de": "der die das und nicht auch sich eine werden haben", "en": "the and that with this from they have been which", "fr": "les des une dans pour que avec sont mais vous"}
    rng = np.random.default_rng(6)
    say = lambda lang, n: " ".join(rng.choice(words_[lang].split(), n).tolist())
    langs = [x for x in words_ for _ in range(20)]
    train = [say(x, 60) for x in langs]
    asked = [say(x, 12) for x in words_ for _ in range(10)] + [say("en", 30_000)]
    asked += asked[:2]

    def plain(text):
        t = " " + re.sub("[^a-z]", " ", text.lower()) + " "
        return [t[i : i + 4] for i in range(len(t) - 3) if "  " not in t[i : i + 4]]

    counts = {}
    for t, x in zip(train, langs):
        for g in plain(t):
            counts.setdefault(x, {}).setdefault(g, 0)
            counts[x][g] += 1
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    most = {g: max(share[x].get(g, 0) for x in share) for x in share for g in share[x]}
    sets = {x: {g for g, s in share[x].items() if s >= language.LEAST_SHARE and s >= language.FAIR_PART * most[g]} for x in share}
    f = language.learn(docs(spark, train, langs))
    got = {r["id"]: r for r in language.identify(docs(spark, asked), f).collect()}
    for i, t in enumerate(asked):
        part = {x: sum(g in sets[x] for g in plain(t)) / len(plain(t)) for x in sorted(sets)}
        best = max(part, key=lambda x: (part[x], [-ord(c) for c in x]))
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - part[best] / sum(part.values())) < 0.01
    assert len(got) == len(asked) and got[len(asked) - 1]["score"] == got[1]["score"]
    same = language.learn(docs(spark, ["aaaa bbbb"] * 2, ["y", "x"]))
    assert language.identify(docs(spark, ["aaaa bbbb"]), same).first()["lang_pred"] == "x"


def test_language_filters_have_no_false_negatives():
    rng = np.random.default_rng(2)
    members = [np.unique(rng.integers(0, 1 << 32, 500, dtype=np.uint32)) for _ in range(11)]
    f = language.Filters([str(i) for i in range(11)], members, "0")
    for k, g in enumerate(members):
        share, n = f.counts(g, np.zeros(len(g), int), 1)
        assert share[0, k] == 1 and n[0] == len(g) and share[0].sum() < 1.2


# 5 ---------------------------------------------------------------------------


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [[str(x) for x in rng.integers(0, 5000, 120)] for _ in range(12)]
    texts = list(ODD)
    for b in base:
        for _ in range(10):
            c = list(b)
            for i in rng.integers(0, 120, rng.integers(0, 5)):
                c[i] = "new"
            texts.append(" ".join(c))
    got = {r["node"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == classes_by_brute_force(texts)
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_query(spark):
    table = sorted(rows("documents", "doc_id", "text"), key=lambda r: r["doc_id"])
    want = classes_by_brute_force([r["text"] for r in table])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op5_jaccard_join(spark, SF).collect()}
    assert got == {table[i]["doc_id"]: (table[c]["doc_id"], n) for i, (c, n) in want.items()}


def test_tiles_of_several_blocks(spark, monkeypatch):
    texts = [" ".join(str(i) for i in range(200)) + f" {k}" for k in range(40)]
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "MEMBERS", 9)
    got = jaccard.near_duplicates(docs(spark, texts)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 39)}


def test_weak_links_make_no_cluster():
    """A bucket of pairwise weakly similar rows and two near copies gives one link, in one tile and over two blocks, and in any batches."""
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 256, (30, jaccard.BANDS * jaccard.ROWS)).astype(np.uint8)
    sig[:, :48] = 7  # about 0.3 alike
    sig[20] = sig[4]
    sig[20, 100:110] += 1
    rows_ = [(1, 0, 0, 0, i) for i in range(30)] + [(2, x, y, b, i) for x, y in ((0, 0), (0, 1), (1, 1)) for i in range(30) for b in [i % 2] if b in (x, y)]
    rows_ += [(3, 0, 0, 0, 4), (3, 0, 0, 0, 20)]
    columns = [pa.array([r[k] for r in rows_], pa.int32() if k in (1, 2, 3) else pa.int64()) for k in range(5)] + [pa.array([sig[r[4]].tobytes() for r in rows_])]
    whole = pa.RecordBatch.from_arrays(columns, names=["bucket", "x", "y", "block", "node", "mark"])
    for size in (7, 30, 1000):
        parts = [whole.slice(i, size) for i in range(0, len(rows_), size)]
        got = [tuple(sorted((r["a"], r["b"]))) for out in jaccard._link(0.8, 1e-7)(iter(parts)) for r in out.to_pylist()]
        assert got == [(4, 20)] * 3


def test_different_texts_under_one_id(spark):
    one, other = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    df = spark.createDataFrame([(1, one), (1, other), (1, ""), (2, one + " x"), (3, other)], "doc_id long, text string")
    got = sorted((r["node"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 0)]
    kept = jaccard.keep_one(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, other), (1, "")])


def test_repeated_rows_and_null_ids(spark):
    one, other = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    df = spark.createDataFrame([(1, one, 1), (1, one, 1), (None, one, 2), (2, other, 3), (None, None, 4)], "doc_id long, text string, node int")
    kept = jaccard.keep_one(df).collect()
    assert sorted((r["doc_id"] is None, r["text"] or "") for r in kept) == [(False, other), (True, ""), (True, one)]


# 6 ---------------------------------------------------------------------------


def test_lines(spark):
    a, b = "l1\nl2\nl3\nl4", "new\nl1\nl2\nl3\nl4\nend"
    texts = [*ODD, a, b, "\n\n\n\n", "l2\nl3"]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in lines.dedup_lines(docs(spark, texts)).collect()}
    n = len(ODD)
    assert got[n] == (a, 0) and got[n + 1] == ("new\nend", 4) and got[n + 2] == ("\n\n\n\n", 0) and got[n + 3] == ("l2\nl3", 0)
    assert got[0] == (None, 0) and got[1] == ("", 0) and got[6] == ("x\ny\nz", 3)
    again = spark.createDataFrame([(1, a), (1, a), (None, a)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["text"]) for r in lines.dedup_lines(again).collect()) == [(False, ""), (False, ""), (True, a)]
    assert lines.dedup_lines(docs(spark, [])).count() == 0


# 7 ---------------------------------------------------------------------------


def test_leaks(spark):
    item = "If a train leaves Boston at 9 and goes 60 km in 2 hours how far has the train gone when Alice meets Alice in Boston"
    moved = item.replace("Boston", "Paris").replace("Alice", "Bob").replace("60", "75").replace("9", "11")
    texts = [f"Intro words here. {item} and more", f"x\n{moved}", "a clean text about trains that leave at 9 and go 60 km", *ODD]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (5, item, "x")], "item_id long, text string, id string")
    got = {r["id"]: (r["item_ids"], r["verbatim"]) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {0: ([1, 5], True), 1: ([1, 5], False)}
    short = spark.createDataFrame([(1, "why does the Alice meet the Alice here")], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, ["why does the Bob meet the Bob here", "why does the Bob meet the Eve here"]), short).collect()
    assert [r["id"] for r in got] == [0]
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0 and decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs(spark, texts), bench).count() == len(texts) - 2


def test_verbatim_leaks_are_found_whatever_they_hold(spark):
    """Copies with few literal words, re-wrapped, inside a sentence, and in lower case; changed numbers are found as re-parameterised."""
    items = ["12 + 30 = 42 and 7 km 9 kg 11 lb", "Alice Bob Carol David Eve Frank Grace Heidi", "WHAT IS THE CAPITAL CITY OF FRANCE", "Photosynthesis turns light into\nchemical energy. Plants store it"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    texts = [f"so {t} and more" for t in items] + [t.replace(" ", "\n") for t in items] + [f"so {t.lower()} and" for t in items] + [items[0].replace("42", "43")]
    got = {r["id"]: (r["item_ids"], r["verbatim"]) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {k: ([k % 4], True) for k in range(12)} | {12: ([0], False)}
    varied = spark.createDataFrame([(1, "The train leaves the station of Boston at 9")], "item_id long, text string")
    texts = ["now the train leaves the station of Paris at 11", "x.\nThe train\nleaves the station of Paris at 11"]
    assert [r["verbatim"] for r in decontaminate.contaminated(docs(spark, texts), varied).collect()] == [False, False]


def template(text):
    """A plain template: a list of (placeholder or word, the word itself)."""
    out = []
    for raw in words(text):
        w = raw.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "%"))
        if not w:
            if raw in set("+*/=<>^"):
                out.append((raw, raw))
            continue
        low = w.lower()
        number = any(c in "0123456789" for c in w)
        after = bool(out) and out[-1][0] == "<number>"
        kind = "<number>" if number else "<unit>" if after and low in decontaminate.UNITS else "<name>" if w[0].isupper() and low not in decontaminate.COMMON else low
        out.append((kind, low))
    return out


def leaks_of_templates(texts, items, window=13):
    """Items found in each text by comparing every window with every window."""
    cut = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    shape = lambda w: [[x for x, (k, _) in enumerate(w) if k[0] == "<" and k[-1] == ">" and len(k) > 1 and w[x][1] == v] for k, v in w if k[0] == "<" and len(k) > 1]
    out = {}
    for i, text in enumerate(texts):
        found, t = {}, template(text)
        for k, item in enumerate(items):
            want = template(item)
            n = min(window, len(want))
            for a in cut(want, n) if n else ():
                for b in cut(t, n):
                    if [x[1] for x in a] == [x[1] for x in b]:
                        found[k] = True
                    free = sum(x[0][0] != "<" or len(x[0]) == 1 for x in a)
                    if free >= decontaminate.LEAST_LITERALS and [x[0] for x in a] == [x[0] for x in b] and shape(a) == shape(b):
                        found.setdefault(k, False)
        if found:
            out[i] = (sorted(found), any(found.values()))
    return out


def test_leaks_by_a_plain_template_matcher(spark):
    """Items of any length, verbatim and re-parameterised, number-heavy, in three scripts, with many marks, and consistent or not."""
    items = [
        "Compute 12 + 30 * 7 / 2 given Alice 5 Bob 6 Carol 9 now and then add 4 km to it", "What is 7 * 8", "Yes", "Alice has 5", "Name the river that flows through Paris and Rouen to the sea in 2 days",
        "Сколько стоит билет если Иван едет из Москва в Киев", "Πόσο κάνει όταν ο Γιώργος πάει από την Αθήνα στην Πάτρα", "wait..........  for (((it))) here!!!!!!!!!!!! and go", "",
    ]
    texts = [f"Before it {t} and after" for t in items] + [
        "Compute 13 + 31 * 8 / 3 given Dan 6 Eve 7 Frank 10 now and then add 5 miles to it", "so what is 9 * 6 then", "Bob has 3", "Name the river that flows through Rome and Ostia to the sea in 3 days", "Name the river that flows through Rome and Rome to the sea in 3 days",
        "Сколько стоит билет если Пётр едет из Тверь в Омск", "Πόσο κάνει όταν ο Νίκος πάει από την Λαμία στην Χίο", "wait for it here and go", "yesterday was fine", *[t or "" for t in ODD], None,
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, hash string")
    got = {r["id"]: (r["item_ids"], r["verbatim"]) for r in decontaminate.contaminated(df, bench).collect()}
    want = leaks_of_templates(texts, items)
    assert got == want
    assert all(k in want[k][0] and want[k][1] for k in range(8))
    n = len(items)
    assert [want.get(n + k, ([], None))[0] for k in range(9)] == [[0], [1], [], [4], [], [5], [6], [7], []]


def test_leaks_query(spark):
    got = {r["doc_id"]: set(r["item_ids"]) for r in queries.op7_decontamination(spark, SF).collect()}
    table = rows("documents", "doc_id", "text")
    assert {i: x for i, x in leaks_by_brute_force(table).items() if x} == got


def test_blocks_of_the_benchmark_agree(spark):
    d, b = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    whole, parts = decontaminate.contaminated(d, b), decontaminate.contaminated(d, b, block=200)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


# 8 ---------------------------------------------------------------------------


def test_urls(spark):
    cases = ["http://www.Example.com/en/1?x#y", "https://a.example.com/en/", "https://b.net/es/x", "ftp://x.org/", None, "", "no scheme/com", "http://net/fr/?q", "http://spam-farm.example.org", "http://x.spam-farm.example.org/a", "http://badnet/es/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("spam-farm.example.org/",), (None,)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.entries(spark, queries.RULES, listed)).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("b.net", "/es/x", "net/es/", "block")
    assert got[3] == ("x.org", "/", None, "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("net", "/fr/", "net/fr/", "block")
    assert got[8] == ("spam-farm.example.org", "", None, "allow") and got[9][2:] == (None, "block")
    assert got[10] == ("badnet", "/es/", None, "allow")
    assert urls.judge_urls(df.limit(0), urls.entries(spark, [], listed.limit(0))).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(df, urls.entries(spark, [], None)).collect()} == {"allow"}


def test_listed_paths_keep_their_case(spark):
    df = spark.createDataFrame([(1, "http://Bad.example/Ads/x"), (2, "http://bad.example/ads/x"), (3, "http://www.plain.example/a")], "page_id long, url string")
    listed = spark.createDataFrame([("BAD.example/Ads/",), ("Plain.Example/",)], "url string")
    got = urls.judge_urls(df, urls.entries(spark, [], listed)).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "allow", 3: "block"}


def test_repeated_long_and_equal_urls(spark):
    long = "http://a.example.com/en/" + "x/" * 50_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://www.example.com/en/"), (3, None), (3, None)], "page_id long, url string").withColumn("__salt", F.lit(1))
    listed = spark.createDataFrame([("example.com/en/",), ("EXAMPLE.com/en/",)], "url string")  # as long as a rule: the rule wins
    got = sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in urls.judge_urls(df, urls.entries(spark, queries.RULES, listed)).collect())
    assert got == [(1, "example.com/en/", "block")] * 2 + [(2, "www.example.com/en/", "allow")] + [(3, "", "allow")] * 2


def test_bloom_filter_passes_every_listed_key(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("entry"))
    words_ = urls.bloom_filter(keys, "entry", 125)
    probe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("entry"), "id").withColumn("block", urls._block(F.col("entry"), 125)).join(words_, "block")
    passed = {r["id"] for r in probe.where(F.col("word").bitwiseAND(urls._mask(F.col("entry"))) == urls._mask(F.col("entry"))).collect()}
    assert set(range(500)) <= passed and len(passed) < 900


# 9 ---------------------------------------------------------------------------


def test_quality_query(spark):
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, SF).collect()}
    label = {r["doc_id"]: r["quality"] for r in rows("labels")}
    held = [i for i in label if held_out(i) and i in got]
    right = [got[i]["predicted"] == label[i] for i in held]
    assert sum(right) / len(right) > 0.93 and len(got) == len(rows("documents", "doc_id"))
    bad, good = [got[i]["score"] for i in held if not label[i]], [got[i]["score"] for i in held if label[i]]
    assert np.mean([a < b for a in bad for b in good]) > 0.97


def test_quality_odd_texts(spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, score int")
    model = quality.train(docs(spark, ODD), labels)
    got = quality.score(docs(spark, ODD).select("doc_id", "text", "key"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.train(docs(spark, ODD), labels.limit(0))
    assert {r["score"] for r in quality.score(docs(spark, ODD).select("doc_id", "text"), none).collect()} == {0.5}
    assert quality.score(docs(spark, []).select("doc_id", "text"), model).count() == 0
    kept = quality.filter_quality(docs(spark, ODD).select("doc_id", "text", "lang"), none)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r["text"] or "" for r in kept.collect()) == sorted(t or "" for t in ODD)


def test_quality_gradient_is_that_of_the_risk():
    """The step direction against differences of the risk, written as plain loops, on both sides of the bound."""
    rng = np.random.default_rng(5)
    up, z = rng.normal(1, 1, (15, 4)), rng.normal(0, 1, (25, 4))
    loss = lambda t: float(np.log1p(np.exp(-t)))

    def parts(w, prior):
        plus = sum(loss(float(x @ w)) for x in up) / len(up)
        minus = sum(loss(-float(x @ w)) for x in z) / len(z) - prior * sum(loss(-float(x @ w)) for x in up) / len(up)
        return prior * plus, minus

    sides = set()
    for prior, w in ((0.3, rng.normal(size=4)), (0.9, np.array([3.0, 2.0, 3.0, 2.0])), (0.95, np.array([0.1, 0.0, 0.2, 0.1]))):
        plus, minus = parts(w, prior)
        sides.add(minus < 0)
        risk = (lambda v: -parts(v, prior)[1]) if minus < 0 else (lambda v: sum(parts(v, prior)))  # noqa: B023
        want = [(risk(w + 1e-6 * e) - risk(w - 1e-6 * e)) / 2e-6 for e in np.eye(4)]
        assert np.allclose(quality.gradient(w, up, z, prior), want, atol=1e-5)
    assert sides == {True, False}


def test_quality_prior_comes_from_scores():
    """Positives and a mixture of known proportions; no negative is ever told apart."""
    rng = np.random.default_rng(7)
    n = len(quality.FEATURES)
    for share in (0.3, 0.6, 0.9):
        good = lambda m: rng.normal(1.5, 1, (m, n))  # noqa: B023, E731
        mixed = np.concatenate([good(int(2000 * share)), rng.normal(-1.5, 1, (2000 - int(2000 * share), n))])
        assert abs(quality.class_prior(good(1500), rng.permutation(mixed)) - share) < 0.06
    assert quality.class_prior(good(5), mixed) == 0.5


def test_quality_ignores_label_0_and_repeated_rows(spark):
    """Relabelled negatives and rows given twice change no score."""
    d = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    labels = queries.table(spark, "/root/testdata/sf0.001", "labels")
    weights = [quality.train(x, y)["weights"] for x, y in ((d, labels), (d, labels.where("quality = 1")), (d.unionByName(d), labels))]
    assert np.array_equal(weights[0], weights[1]) and np.allclose(weights[0], weights[2])


# 10 --------------------------------------------------------------------------


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = [*ODD, "It's 12,500 o'clock — l'été  \t\n\n x<|endoftext|>y <|endoftext|>", "a" * 700, "ab" * 400 + "!" * 300, "日本語 العربية हिन्दी \x00\x1c\x85　z", "   x", "'S 'RE 're", "👨‍👩‍👧 ñandú"]
    texts += [r["text"] for r in rows("documents", "text")[:200]]
    out = bpe.decode(bpe.encode(docs(spark, texts), path), path).collect()
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False) == (r["text"] or "")
    assert sorted(map(str, bpe.round_trip(docs(spark, texts), path).collect())) == sorted(map(str, out))
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_bpe_long_words_clashing_columns_and_repeated_rows(spark):
    import time

    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(), np.random.default_rng(9)
    library = Tokenizer.from_file(path)
    word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000).tolist())
    df = spark.createDataFrame([(1, word, [1], "old"), (1, word, [1], "old"), (2, "日本語" * 3000, None, None)], "doc_id long, text string, ids array<int>, Decoded string")
    out = bpe.round_trip(df, path)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2]
    assert all(r["ids"] == library.encode(r["text"], add_special_tokens=False).ids and r["decoded"] == r["text"] for r in got)
    v = bpe.Vocabulary.at(path)
    parts = v.first[np.frombuffer("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000).tolist()).encode(), np.uint8)]
    began = time.process_time()
    v.merge_long(parts)
    assert time.process_time() - began < 5


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: r for r in queries.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        ids, text = library.encode(r["text"] or "", add_special_tokens=False).ids, (r["text"] or "").encode()
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())


# all -------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*sorted(want.columns))
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())

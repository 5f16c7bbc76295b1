"""Similar strings, strings in texts, and the four tiers, against plain versions."""

import random

from pyspark.sql import functions as F

from assayer.operators import locating, matching, nearness
from assayer.plans import evidence_queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_similar_strings_are_all_found(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcde ", k=rng.randint(1, 14))).strip() for _ in range(120)] + ["aaaaaaaa", "aaaaaaa", "abababab", "x", "xy", "", "é" * 300]
    wrong = []
    for b in base:
        s = list(b)
        for _ in range(rng.randint(0, 2)):
            if s and rng.random() < 0.5:
                s.pop(rng.randrange(len(s)))
            else:
                s.insert(rng.randint(0, len(s)), rng.choice("abcde "))
        wrong.append("".join(s))
    tidy = lambda xs: sorted({" ".join(sorted(x.split())) for x in xs} - {""})
    a, b = tidy(base), tidy(wrong)
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, *xs[:5], None, ""]], "s string")
    for least in (82.0, 90.0, 100.0):
        got = {(r["s"], r["t"]): r["ratio"] for r in nearness.similar(frame(a), frame(b), least).collect()}
        plain = {(x, y): 200 * lcs(x, y) / (len(x) + len(y)) for x in a for y in b}
        assert got == {k: v for k, v in plain.items() if v >= least or k[0] == k[1]}
    assert nearness.similar(frame(a).limit(0), frame(b)).count() == 0


def test_typing_errors_meet_the_document_s_own_skills(spark):
    edges = spark.createDataFrame([("React", "Vue", 0)], "skill string, near string, ord int")
    skills = spark.createDataFrame([(1, "kubernetes", "experience_bullet", 0, 20), (1, "Slack", "skills_list", 1, 0), (1, "Vue", "skills_list", 2, 0), (2, "postgresql", "skills_list", 0, 0), (2, "Flask", "skills_list", 3, 0)], "pair_id int, canonical string, origin string, ord int, months long")
    rows = [(1, 0, "kubernetes", None, None, "tool"), (1, 1, None, "kubernets", None, "tool"), (1, 2, None, "Flask", None, "tool"), (1, 3, "React", None, None, "tool"), (1, 4, None, "• led  a team of five;", None, "responsibility"), (1, 5, None, "kubernets", 3.0, "tool"), (2, 0, "postgresqll", None, None, "tool"), (2, 1, None, "kubernets", None, "tool"), (2, 2, "React", None, None, "tool"), (2, 3, None, "led a team", None, "tool"), (2, 4, None, "ab", None, "tool"), (2, 5, None, None, None, None)]
    asked = spark.createDataFrame(rows, "pair_id int, requirement_id int, canonical string, text string, years double, category string")
    texts = spark.createDataFrame([(1, "We led a\nteam of five people."), (2, "led a team")], "pair_id int, text string")
    got = {(r["pair_id"], r["requirement_id"]): (r["tier"], r["skill"], r["status"]) for r in matching.cascade(asked, skills, edges, documents=texts, explain=True).collect()}
    assert got == {(1, 0): ("exact", "kubernetes", "matched"), (1, 1): ("fuzzy", "kubernetes", "matched"), (1, 2): (None, None, "missing"), (1, 3): ("adjacent", "Vue", "partial"), (1, 4): ("literal", None, "partial"), (1, 5): ("fuzzy", "kubernetes", "partial"), (2, 0): ("fuzzy", "postgresql", "partial"), (2, 1): (None, None, "missing"), (2, 2): (None, None, "missing"), (2, 3): (None, None, "missing"), (2, 4): (None, None, "missing"), (2, 5): (None, None, "missing")}
    known = spark.createDataFrame([("PostgreSQLL", "postgresqll", 0)], "canonical string, alias string, ord int")
    strict = matching.cascade(asked, skills, edges, taxonomy=known, explain=True).where("pair_id = 2 AND requirement_id = 0").first()
    assert strict["status"] == "missing"  # a name that the taxonomy knows is another skill


def test_requirements_and_skills_meet_once(spark):
    """All tiers are read off one row a requirement: one shuffle by key of each side, whatever the tiers."""
    rows = spark.createDataFrame([(i, k, f"s{k}", None) for i in range(4) for k in range(3)], "pair_id int, requirement_id int, canonical string, years double")
    skills = spark.createDataFrame([(i, f"s{k + 1}", "summary", k, 1) for i in range(4) for k in range(2)], "pair_id int, canonical string, origin string, ord int, months long")
    out = matching.cascade(rows, skills, spark.createDataFrame([("s0", "s2", 0)], "skill string, near string, ord int"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted((r["requirement_id"], r["status"], r["via"]) for r in out.where("pair_id = 3").collect()) == [(0, "partial", "s2"), (1, "matched", None), (2, "matched", None)]


def test_pairs_that_share_a_document_seek_a_wording_once(spark, monkeypatch):
    asked = spark.createDataFrame([(i, k, w, "responsibility") for i in range(5) for k, w in enumerate(("led a team", "absent"))], "pair_id int, requirement_id int, text string, category string")
    shared = spark.createDataFrame([(i, i % 2) for i in range(5)], "pair_id int, document_id int")
    documents = spark.createDataFrame([(0, "who led a team"), (1, "nothing")], "document_id int, text string")
    sought = []
    located = locating.located
    monkeypatch.setattr(locating, "located", lambda d, n, *a, **k: (sought.append(n.count()), located(d, n, *a, **k))[1])
    got = matching.literal(asked, documents, ["pair_id"], shared)
    assert sought == [4] and sorted(map(tuple, got.collect())) == [(0, 0), (2, 0), (4, 0)]


def test_evidence_of_one_rank_and_place_is_the_last_origin_by_name(spark):
    for origins in (("education", "skills_list"), ("skills_list", "education")):
        rows = spark.createDataFrame([(1, "s", o, 7) for o in origins], "pair_id int, canonical string, origin string, ord int").coalesce(1)
        assert [r["origin"] for r in matching.strongest(rows, ["pair_id", "canonical"]).collect()] == ["skills_list"]


def plain_locate(text, needle):
    """The rule, written down naively."""
    if not needle:
        return None
    if needle in text:
        return "exact", text.index(needle), text.index(needle) + len(needle)
    bare = needle.strip(" \t•-–—*·.,;:")
    if not bare:
        return None
    if bare in text:
        return "trimmed", text.index(bare), text.index(bare) + len(bare)
    words = bare.split()
    for start in range(len(text)):
        at = start
        for n, w in enumerate(words):
            if n:
                gap = len(text[at:]) - len(text[at:].lstrip())
                if not gap:
                    break
                at += gap
            if not text.startswith(w, at):
                break
            at += len(w)
        else:
            return "collapsed", start, at
    return None


def test_needles_in_one_text(spark):
    rng = random.Random(6)
    text = "• Led the team  of five\n\tpeople. Cut costs; led the team of five people, é—x. "
    needles = ["Led the team", "• Led the team of five people.", "Led the team,", "led the team of five people", "* Cut costs.", "absent", "", "•", " ", "people.  Cut", "é—x", "team of five people", "five people"]
    needles += ["".join(rng.choices(" \t.;adelmt•\n", k=rng.randint(1, 8))) for _ in range(300)]
    got = locating.locate_all(text, needles)
    assert [g and (g[0], *g[1][0]) for g in got] == [plain_locate(text, n) for n in needles]
    assert got[0][1] == [(2, 14)] and locating.places("aaa", ["aa", "b"]) == {"aa": [0, 1]}
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "d int, text string, needle string")
    rows = [(1, i, n) for i, n in enumerate(needles)] + [(2, 0, "a"), (3, 0, "a"), (9, 0, "a"), (1, 5000, None), (1, 0, needles[0])]
    found = locating.located(docs.drop("needle"), spark.createDataFrame(rows, "d int, i int, needle string"), ["d"], "i")
    assert sorted((r["d"], r["i"], r["form"], r["start"], r["end"]) for r in found.collect()) == sorted((1, i, *p) for i, p in enumerate(map(plain_locate, [text] * len(needles), needles)) if p)


def test_a_text_that_many_needles_ask_about_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(locating, "SHARE", 10)
    docs = spark.createDataFrame([(1, " ".join(f"w{i}." for i in range(300)))], "d int, text string")
    asked = spark.createDataFrame([(1, i, f"- w{i};") for i in range(300)], "d int, i int, needle string")
    got = {r["i"]: r["start"] for r in locating.located(docs, asked, ["d"], "i").collect()}
    text = " ".join(f"w{i}." for i in range(300))
    assert got == {i: text.index(f"w{i}") for i in range(300)}


def test_needles_anywhere(spark):
    texts = ["abc abcd", "", None, "xabcx é", "nothing"]
    asked = [(1, "abc"), (2, "abcd"), (3, "bc"), (4, "é"), (5, ""), (6, None), (7, "abc"), (8, "zz")]
    docs, needles = spark.createDataFrame(list(enumerate(texts)), "d int, text string"), spark.createDataFrame(asked, "i int, needle string")
    want = sorted((d, i, t.index(n)) for d, t in enumerate(texts) for i, n in asked if t and n and n in t)
    for most in (1 << 20, 4):  # one block, and several
        assert sorted(map(tuple, locating.anywhere(docs, needles, "d", "i", most_chars=most).collect())) == want
    assert locating.anywhere(docs, needles.limit(0), "d", "i").count() == 0


def test_cascade_reads_its_tables_and_strings_once(spark):
    plan = evidence_queries.cascade_tiers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") <= 4 and plan.count("Exchange") <= 30


def test_lengths_that_are_just_alike(spark):
    for least in (70.0, 82.0, 100.0):
        words = ["a" * n for n in range(1, 70)]
        frame = spark.createDataFrame([(w,) for w in words], "s string")
        few = frame.where(F.length("s").isin(1, 9, 41))
        want = {(s, t) for s in words for t in words if len(t) in (1, 9, 41) and (s == t or 200 * min(len(s), len(t)) >= least * (len(s) + len(t)) and min(len(s), len(t)) > 1)}
        assert {(r["s"], r["t"]) for r in nearness.similar(frame, few, least).collect()} == want
        assert {(r["t"], r["s"]) for r in nearness.similar(few, frame, least).collect()} == want

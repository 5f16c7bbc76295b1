"""Normalised texts and their way back, against lists of single characters."""

import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from assayer.operators import normalising as N
from assayer.plans import evidence_queries


def plain(text):
    """Pairs of character and place, step by step."""
    pairs = [(c, i) for i, ch in enumerate(text) for c in (N.FIXED.get(ch) or unicodedata.normalize("NFKC", ch) if ord(ch) > 127 else ch)]
    out, begin = [], True
    for c, i in pairs:
        out.append((N.BULLET if begin and c in N.BULLETS else c, i))
        begin = c == "\n" or begin and c in " \t"
    pairs = out
    for m in reversed(list(re.finditer(r"([A-Za-z]{2,})-\n([a-z]{2,})", "".join(c for c, _ in pairs)))):
        del pairs[m.end(1) : m.end(1) + 2]
    out = []
    for c, i in pairs:
        if c in " \t":
            if not out or out[-1][0] != " ":
                out.append((" ", i))
            continue
        while c == "\n" and out and out[-1][0] == " ":
            out.pop()
        out.append((c, i))
    while out and out[-1][0] == " ":
        out.pop()
    lines, repairs = [[]], 0
    for p in out:
        lines[-1].append(p)
        if p[0] == "\n":
            lines.append([])
    done = []
    for line in lines:
        spaced = re.fullmatch(r"(?:[A-Za-z]\s){2,}[A-Za-z]", "".join(c for c, _ in line).strip())
        repairs += bool(spaced)
        done += [p for p in line if p[0] != " "] if spaced else line
    return "".join(c for c, _ in done), [i for _, i in done], repairs


TEXTS = ["", "a", " ", "Proﬁled  the\t\tauto-\nmation  \n", "● one\n – two — x\n\t* three", "E X P E R I E N C E\n  S K I L L S  \nA B\nC D E", "½ “quoted”… ™  end  ", "ab-\ncd-\nef a-\nb", "日本 ① ㎏\n\n\n- x", "- \n-\n --", "no change at all"]


def test_steps_and_their_way_back(spark):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choices(["ab", "C", "D ", " ", "  ", "\t", "-", "\n", "-\n", "•", "—", "ﬁ", "½", "…", " ", "E F G"], k=rng.randint(1, 30))) for _ in range(400)]
    for t in texts:
        text, back, repairs = N.normalise(t)
        want, sources, n = plain(t)
        assert (text, repairs) == (want, n)
        assert back.back(np.arange(len(text))).tolist() == sources and back.size == len(text)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    out = N.normalised(df)
    places = F.transform(F.sequence(F.lit(0), F.length("normalised") - 1), lambda k: N.original_place(k, F.col("at"), F.col("source")))
    got = {r["id"]: r for r in out.withColumn("places", F.when(F.length("normalised") > 0, places)).collect()}
    for i, t in enumerate(texts):
        want, sources, n = plain(t)
        assert (got[i]["normalised"], got[i]["places"] or [], got[i]["repairs"]) == (want, sources, n)
    assert got[len(texts)]["normalised"] is None
    assert all(len(got[i]["at"]) <= 1 + 3 * len(t) for i, t in enumerate(texts)) and len(got[TEXTS.index("no change at all")]["at"]) == 1


def test_span_in_the_original(spark):
    text = "• Proﬁled  the auto-\nmation work"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    out = N.normalised(df).withColumn("a", F.instr("normalised", "Profiled the automation") - 1)
    r = out.select(N.original_span(F.col("a"), F.col("a") + 23, F.col("at"), F.col("source")).alias("s"), N.original_span(F.col("a"), F.col("a"), F.col("at"), F.col("source")).alias("none")).first()
    assert text[r["s"]["start"] : r["s"]["end"]] == "Proﬁled  the auto-\nmation" and r["none"] is None


def test_lines_stay_in_the_row_of_their_text(spark):
    plan = evidence_queries.normalised_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan

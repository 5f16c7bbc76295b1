"""Folding, redaction with a way back, located claims, prompts, progress."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators import offsets, resumes


def test_folding(spark):
    df = spark.createDataFrame([(1, "ﬁne ½ x"), (2, None), (3, "")], "doc_id int, text string")
    got = {r["id"]: r for r in offsets.folded(df).collect()}
    assert got[1]["folded"] == "fine 1⁄2 x" and got[1]["sources"] == [0, 0, 1, 2, 3, 4, 4, 4, 5, 6]
    assert got[2]["folded"] is None and got[3]["folded"] == ""
    span = offsets.folded(df).where("id = 1").select(offsets.original_span(F.col("sources"), F.lit(0), F.lit(2)).alias("s"), offsets.original_span(F.col("sources"), F.lit(3), F.lit(99)).alias("n")).first()
    assert tuple(span["s"]) == (0, 1) and span["n"] is None


def test_redaction_restores(spark):
    text = "Ada Lovelace (ada@x.org, ADA@X.ORG) wrote to bob@y.org; Lovelace lives in Paris."
    df = spark.createDataFrame([(1, text, ("Ada Lovelace", None, None, "Paris", None)), (2, None, None), (3, "nothing", None)], "doc_id int, text string, contact struct<name:string,email:string,phone:string,location:string,links:array<string>>")
    out = offsets.redacted(df, contact_col="contact")
    got = {r["id"]: r for r in out.withColumn("back", offsets.restored(F.col("redacted"), F.col("placeholders"))).collect()}
    assert got[1]["redacted"] == "[NAME] ([EMAIL], [EMAIL]) wrote to [EMAIL_2]; [NAME_2] lives in [LOCATION]."
    assert got[1]["back"].lower() == text.lower() and got[2]["redacted"] is None and got[3]["redacted"] == "nothing"
    at = got[1]["redacted"].index("wrote")
    assert out.where("id = 1").select(offsets.original_offset(F.lit(at), F.col("breaks"), F.col("shifts"))).first()[0] == text.index("wrote")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab @.x1-", max_size=40))
def test_redaction_is_idempotent(text):
    once = offsets.redact_text(text, [])["text"]
    assert offsets.redact_text(once, [])["text"] == once


def test_bullets_and_claims(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, item int, bullets array<string>")
    got = resumes.all_bullets(part((1, 0, ["s"])), part((1, 1, ["e2"]), (1, 0, ["e0", " ", "e1"])), part(), part((1, 0, ["d"]))).orderBy("ord").collect()
    assert [(r["origin"], r["text"]) for r in got] == [("summary", "s"), ("experience_bullet", "e0"), ("experience_bullet", "e1"), ("experience_bullet", "e2"), ("education", "d")]
    docs = spark.createDataFrame([(1, "built a\n big (thing) here")], "doc_id int, text string")
    claims = spark.createDataFrame([(1, "a big (thing)"), (1, " here "), (1, "missing")], "doc_id int, text string")
    got = {r["text"]: (r["start"], r["end"]) for r in resumes.located(claims, docs).collect()}
    assert got["a big (thing)"] == (6, 20) and got[" here "] == (21, 25) and got["missing"] == (None, None)
    assert resumes.verified_share(resumes.located(claims, docs)).first()["span_verification"] == 0.667


def test_prompts_rewrites_progress(spark):
    b = spark.createDataFrame([(1, 1, "two"), (1, 0, "one")], "doc_id int, ord int, text string")
    assert resumes.judge_prompt(b).first()["prompt"] == "- one\n- two"
    rewrites = spark.createDataFrame([(1, 1, "Cut costs by 40%"), (1, 2, "Cut costs for 40000 users"), (2, 1, "Built it at Acme"), (3, 1, "Led the Globex work")], "i int, attempt int, suggestion string")
    originals = spark.createDataFrame([(1, "cut costs for 40K users", None), (2, "built it", "Engineer, Acme"), (3, "led work", None)], "i int, original string, context string")
    got = {r["i"]: r["attempt"] for r in resumes.accept_grounded(rewrites, originals, ["i"]).collect()}
    assert got == {1: 2, 2: 1}
    e = spark.createDataFrame([(1, 0, "validating"), (1, 1, "scoring"), (1, 2, "matching"), (1, 3, "done")], "run int, t int, stage string")
    assert [r["percent"] for r in resumes.monotone(e, ["run"], "t").orderBy("t").collect()] == [5, 90, 90, 100]
    s = spark.createDataFrame([(1, "a", 5, "ok"), (1, "b", 7, "degraded")], "run int, stage string, ms int, status string")
    r = resumes.timings(s, ["run"]).first()
    assert r["timings"] == {"a": 5, "b": 7} and r["total_ms"] == 12 and r["degraded"]


def test_texts_are_folded_in_portions(monkeypatch):
    monkeypatch.setattr(offsets, "PORTION", 10)
    texts = ["aaaa", None, "bbbb", "", "c" * 50, "dd", "eeee", "ﬁ"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["id", "text"])
    for part in (batch, batch.slice(2, 5)):
        cut = list(offsets.portions(part, 1))
        assert pa.Table.from_batches(cut).to_pylist() == part.to_pylist()
        assert all(c.num_rows == 1 or sum(len(t or "") for t in c["text"].to_pylist()[:-1]) <= 10 for c in cut) and len(cut) > 1
    assert list(offsets.portions(batch.slice(0, 0), 1)) == []


def test_a_heading_is_tidied_once(spark):
    """Not once for each phrase that it may contain."""
    assert T.section_kind(F.col("x"))._jc.toString().count("regexp_replace") == 3
    rows = spark.createDataFrame([("My Work Experience:",), ("SKILLS",), ("...",), (None,), ("nothing of the kind in here",)], "x string")
    assert [r[0] for r in rows.select(T.section_kind(F.col("x"))).collect()] == ["experience", "skills", None, None, None]
    assert [r[0] for r in rows.select(T.contains_any(F.col("x"), ["skills", "work"])).collect()] == [True, True, False, None, False]

"""Working names never clash with a caller's columns."""

import corpus_pipeline
from assayer.llm import decontaminate, jaccard, lines

NAMES = ["__id", "__copy", "__node", "__gone", "__s_id", "__s_copy", "s_id", "s_copy", "__ID_", "removed", "hash", "first", "n", "pos", "spots"]


def test_columns_of_any_name_stay(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    texts = ["a\nb\nc\nd", "a\nb\nc\ne", passage, passage + " more", None, ""]
    df = spark.createDataFrame([(i, t, *range(len(NAMES))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = decontaminate.decontaminate(df, items)
    one = jaccard.keep_one(df)
    short = lines.dedup_lines(df)
    assert sorted(r["doc_id"] for r in clean.collect()) == [0, 1, 4, 5] and clean.columns == df.columns
    assert sorted(r["doc_id"] for r in one.collect()) == [0, 1, 2, 4, 5] and one.columns == df.columns
    got = {r["doc_id"]: r for r in short.collect()}
    assert short.columns == [*df.columns, "removed_lines"] and got[1]["text"] == "e" and got[1]["removed_lines"] == 3 and got[0]["text"] == "a\nb\nc\nd" and got[4]["text"] is None
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for df_ in (clean, one, short) for r in df_.collect())


def test_line_stage_keeps_a_column_called_like_its_count(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", 7, 9), (2, "a\nb\nc\ne", 7, 8), (3, "a\nb\nc", 5, 7)], "doc_id long, text string, n_chars long, removed_lines int")
    got = corpus_pipeline.drop_repeated_lines(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb\nc\nd", 7, 9), (2, "e", 1, 8)]

"""The pipeline against a plain version of every stage."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from assayer.llm import arrays, quality, queries, shared
from llm_brute import classes_by_brute_force, held_out, leaks_by_brute_force, rows, words

SF = "/root/testdata/sf0.01"


def kept_lines(texts):
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n")
        trimmed, gone = [x.strip(" ") for x in lines], set()
        for i in range(len(lines) - 2):
            w = tuple(trimmed[i : i + 3])
            if any(w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_pipeline(spark):
    docs = sorted(rows("documents"), key=lambda r: r["doc_id"])
    training = queries.table(spark, SF, "documents").where(~queries.held_out())
    assert {r["doc_id"] for r in training.select("doc_id").collect()} == {r["doc_id"] for r in docs if not held_out(r["doc_id"])}
    model = quality.train(training, queries.table(spark, SF, "labels"))
    good = []
    for r in docs:
        x = quality.figures(*arrays.texts_of(pa.array([r["text"]])))
        if 1 / (1 + np.exp(-(quality.expand(x, model["mid"], model["wide"]) @ model["weights"])[0])) >= 0.5:
            good.append(r)
    for r, text in zip(good, kept_lines([r["text"] for r in good])):
        r["emptied"], r["text"] = bool(words(r["text"])) and not words(text), text
    good = [r for r in good if not r["emptied"]]
    classes = classes_by_brute_force([r["text"] for r in good])
    unique = [r for i, r in enumerate(good) if classes[i][0] == i]
    leaked = leaks_by_brute_force(unique)
    want = {r["doc_id"]: r["text"] or "" for r in unique if not leaked[r["doc_id"]]}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "exact"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(want)
    library = Tokenizer.from_file(queries.tokenizer_path())
    assert all(r["n_tokens"] > 0 for i, r in got.items() if want[i])
    for i, text in want.items():
        assert got[i]["exact"] and got[i]["n_tokens"] == len(got[i]["ids"])
    for i in list(want)[:100]:
        assert got[i]["ids"] == library.encode(want[i], add_special_tokens=False).ids


def test_stages_keep_columns_and_odd_rows(spark):
    odd = [(1, None, None, None, None, "e"), (None, "x y z", "en", "s", 5, "e"), (3, "", "en", "s", 0, "e"), (4, "word " * 9000, "en", None, 45000, "e"), (4, "word " * 9000, "en", None, 45000, "e")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, node string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.where(F.col("doc_id") == 1).count() <= 1 and out.count() <= docs.count(), name
        assert name == "quality" or out.where(F.col("doc_id") == 1).count() == 1, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    verdicts = {(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    assert corpus_pipeline.keep_quality(spark, docs, SF).where("doc_id = 4").count() == (2 if (4, "word " * 9000) in verdicts else 0)
    assert corpus_pipeline.tokenize(spark, docs, SF).where("exact").count() == 5


def test_emptied_documents_go_and_blank_ones_stay(spark):
    a = "one two\nthree four\nfive six"
    data = [(1, a, 9), (2, a, 9), (3, " \n\n ", 9), (4, None, 9), (5, a + "\nmore", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {1: (a, len(a)), 3: (" \n\n ", 4), 4: (None, None), 5: ("more", 4)}


def test_kept_tables_go_when_they_are_released(spark):
    mark = shared.kept_tables()
    with shared.released(spark):
        df = shared.keep(spark.range(5), "some")
        table = shared.keep_bucketed(spark.range(5), "other", "id", 2)
        assert df.count() == table.count() == 5 and shared.kept_tables() == mark + 2
        files = df.inputFiles()
    assert shared.kept_tables() == mark
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
    first = shared.keep(spark.range(3), "first")
    assert shared.hand_over(first.where("id > 0"), "second", mark).count() == 2
    assert shared.kept_tables() == mark + 1 and shared.release(spark, mark) == 1

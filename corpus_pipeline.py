"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, jaccard, lines, quality
from assayer.llm.queries import held_out, table, tokenizer_path
from assayer.llm.shared import bounded_batches, free_name, hand_over, kept_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the training rows of ``docs``, doesn't reject.

    A null text is scored as an empty one; equal rows share a verdict; a text of
    any length is scored whole; an empty table stays empty. Columns stay as they
    are, whatever their names.
    """
    model = quality.train(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return quality.filter_quality(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later occurrences of three-line windows; ``n_chars`` follows the text.

    A document that had words and loses them all repeats earlier ones line by
    line, and goes. Null, empty and blank texts stay as they are. Rows equal in id
    and text are treated alike; ties of ids go by the texts' hashes; a text of any
    length is read whole; an empty table stays empty. Columns stay as they are,
    whatever their names.
    """
    aside = free_name(docs, "own_removed_lines")  # a column that is called like the operator's count
    out = lines.dedup_lines(docs.withColumnRenamed("removed_lines", aside)).where((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    of = lambda c: F.length("text").cast("long") if c == "n_chars" else F.col(f"`{aside if c.lower() == 'removed_lines' else c}`")
    return out.select(*[of(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Null texts and texts without words all stay, rows equal in id and text count
    once; null ids take part; a text of any length is compared whole; an empty
    table stays empty. Columns stay as they are, whatever their names.
    """
    bounded_batches(spark)
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window.

    Null and empty texts stay; equal rows share a verdict; a null id is an id of
    its own; a text of any length is read whole; an empty table stays empty.
    Columns stay as they are, whatever their names.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, token ids and token count of every document, and whether they decode to its text.

    A null text counts as empty and has no ids; equal rows and null ids stay; a
    text of any length is encoded whole; an empty table stays empty. Only
    ``doc_id`` and ``text`` are read, whatever other columns are called.
    """
    bounded_batches(spark)
    out = bpe.round_trip(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), tokenizer_path())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("text") == F.col("decoded")).alias("exact"))


STAGES = [("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("tokens", tokenize)]

#: The classifier and the tokenizer aren't SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's table is deleted once the next one's is written; the last stays until ``shared.release``."""
    docs, mark = table(spark, sf_dir, "documents"), kept_tables()
    for name, stage in STAGES[:-1]:
        docs = hand_over(stage(spark, docs, sf_dir), name, mark)
    return STAGES[-1][1](spark, docs, sf_dir)

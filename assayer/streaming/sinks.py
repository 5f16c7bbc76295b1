"""Sinks for ``foreachBatch`` that a replayed batch leaves unchanged.

A batch writes folders of its own, named by its number, and overwrites them when it is
run again. Nothing else is updated in place: readers merge the folders.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import cohort

#: The tables of an analysis run: columns of each, its id first, its content hash last.
RUN_TABLES = {"resumes": ["resume_id", "user_id", "resume", "file_hash"], "job_targets": ["job_id", "user_id", "job", "jd_hash"], "analyses": ["id", "user_id", "resume_id", "job_id", "scores", "report", "created_at", "content_hash"]}


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that a folder has, ascending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))


def _read(spark: SparkSession, folder: str, numbers: Sequence[int], schema: str) -> DataFrame:
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/batch={n}" for n in numbers]).withColumn("batch", F.col("batch").cast("long"))


def save_runs(folder: str, run_tables: Mapping[str, Sequence[str]] = RUN_TABLES) -> Callable[[DataFrame, int], None]:
    """Writes each analysis run of a batch to several tables.

    A row is written if no earlier batch has its id with its content hash, once
    however often it comes; a row whose hash changed is written as a new version.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            for name, columns in run_tables.items():
                place, (key, content) = f"{folder}/{name}", (columns[0], columns[-1])
                rows = batch.select(*columns).dropDuplicates([key, content])
                known = _read(spark, place, [n for n in _batches(spark, place) if n < number], ", ".join(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in columns))
                same = rows[key].eqNullSafe(known[key]) & rows[content].eqNullSafe(known[content])
                rows.join(known.select(key, content), same, "left_anti").write.mode("overwrite").parquet(f"{place}/batch={number}")
        finally:
            batch.unpersist()

    return write


def saved(spark: SparkSession, folder: str, name: str, schema: str, run_tables: Mapping[str, Sequence[str]] = RUN_TABLES) -> DataFrame:
    """The latest version of each row of a saved table; within a batch the largest hash counts."""
    place, (key, content) = f"{folder}/{name}", (run_tables[name][0], run_tables[name][-1])
    rows = _read(spark, place, _batches(spark, place), schema)
    columns = [c for c in rows.columns if c != "batch"]
    last = F.max_by(F.struct(*columns), F.struct("batch", content)).alias("row")
    return rows.groupBy(key).agg(last).select("row.*")


def count_samples(folder: str, keys: Sequence[str], metrics: Sequence[str], merge_every: int = 16) -> Callable[[DataFrame, int], None]:
    """Keeps how often each value of each metric occurs in each cohort, one pass over new rows only.

    Every ``merge_every`` batches their counts and the counts merged before become one folder, so readers
    open few folders however long the stream runs.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = cohort.long_form(batch, keys, metrics).groupBy(*keys, "metric", "value").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/new/batch={number}")
        if number % merge_every == merge_every - 1:
            merged = sample_counts(spark, folder, counts.schema.simpleString().removeprefix("struct<").removesuffix(">"), number, before=number)
            merged.write.mode("overwrite").parquet(f"{folder}/merged/batch={number}")

    return write


def sample_counts(spark: SparkSession, folder: str, schema: str, upto: int | None = None, before: int | None = None) -> DataFrame:
    """Counts of all batches up to ``upto``: the last merged folder (of those ``before`` a number) and the batches since."""
    schema = ", ".join(" ".join(p.split(":", 1)) for p in schema.split(","))
    merged = [n for n in _batches(spark, f"{folder}/merged") if (before is None or n < before) and (upto is None or n <= upto)]
    since = merged[-1] if merged else -1
    new = [n for n in _batches(spark, f"{folder}/new") if n > since and (upto is None or n <= upto)]
    both = _read(spark, f"{folder}/new", new, schema).drop("batch").unionByName(_read(spark, f"{folder}/merged", merged[-1:], schema).drop("batch"))
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))

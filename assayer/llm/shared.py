"""Tables that cut lineage, kept where every executor can read them, until they are released."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from assayer.sources.kept import _kept, keep, shared_dir


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB or 4,000 rows at most, so that long texts don't fill a Python worker; what the session has set itself stays."""
    for name, value in (("maxRecordsPerBatch", "4000"), ("maxBytesPerBatch", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores behind it as no column of ``df`` is called so, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keep_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``keep``, as a table bucketed by ``key`` whose files lie in the shared folder, too: later groupings on it need no shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    _kept.append((table, path))
    return spark.table(table)


def release(spark: SparkSession, down_to: int = 0) -> int:
    """Delete what ``keep`` and ``keep_bucketed`` have written, the newest first, all but ``down_to``; returns how many.

    For when every result that was built on them has been written: a DataFrame
    that still reads a released table fails.
    """
    n = 0
    while len(_kept) > down_to:
        table, name = _kept.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        n += 1
    return n


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was kept inside, so results must be written before."""
    mark = len(_kept)
    try:
        yield
    finally:
        release(spark, mark)


def hand_over(df: DataFrame, name: str, mark: int) -> DataFrame:
    """``keep`` a result and delete what was kept since there were ``mark`` tables, which it was built on."""
    out = keep(df, name)
    newest = _kept.pop()
    release(df.sparkSession, mark)
    _kept.append(newest)
    return out


def kept_tables() -> int:
    """How many tables are kept just now."""
    return len(_kept)

"""Tables that cut a plan in two, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What ``keep`` (and ``llm.shared.keep_bucketed``) has written and is not yet deleted, oldest first: name of the table, if it is one, and path.
_kept: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where it is unset, and the master is local (as in tests), a temporary
    folder serves; on a cluster a missing folder is an error, since executors
    wouldn't see one another's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def keep(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once, with the writer's ``options``, and read it back, so that no later job computes it again.

    The table survives the loss of any executor. A written table holds no rows
    of unknown type, so its schema is passed to the reader instead of inferred.
    It stays until its folder is cleared, or until ``llm.shared`` releases it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _kept.append(("", path))
    return spark.read.schema(df.schema).parquet(path)

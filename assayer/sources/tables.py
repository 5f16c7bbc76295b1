"""Tables: reading with projection and filters, appending, updating, deleting, exporting."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPS = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def dealt_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for row-wise work on long texts; one that fits a single split is dealt out to all cores, as one task would read it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    rows = table(spark, folder, name)
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= split else rows


def condition(filters: Mapping[str, Any]) -> Column:
    """``{"id": "eq.7", "age": "gte.18", "gone": "is.null"}``, or plain values, as one condition. Numbers in operators compare as numbers."""
    out = F.lit(True)
    for column, wanted in filters.items():
        op, _, value = wanted.partition(".") if isinstance(wanted, str) else ("eq", "", wanted)
        if isinstance(wanted, str) and op == "is":
            out = out & (F.col(column).isNull() if value == "null" else F.col(column) == (value == "true"))
        elif isinstance(wanted, str) and op == "in":
            out = out & F.col(column).isin(*value.strip("()").split(","))
        elif isinstance(wanted, str) and op in _OPS:
            other = F.lit(float(value)) if re.fullmatch(r"-?\d+(\.\d+)?", value) else F.lit(value)
            out = out & getattr(F.col(column), _OPS[op])(other)
        else:
            out = out & (F.col(column) == F.lit(wanted))
    return out


def select(source: DataFrame, columns: Sequence[str] = (), filters: Mapping[str, Any] | None = None, order: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Projection, filters, ``order`` such as ``created_at.desc,id.asc``, offset and limit; filters and columns reach the scan."""
    out = source.where(condition(filters)) if filters else source
    if order:
        keys = [k.partition(".") for k in order.split(",")]
        out = out.orderBy(*[F.desc(c) if way == "desc" else F.asc(c) for c, _, way in keys])
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*columns) if columns else out


def insert(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows to a Parquet table."""
    (rows.write.mode("append").partitionBy(*partition_by) if partition_by else rows.write.mode("append")).parquet(path)


def update(source: DataFrame, filters: Mapping[str, Any], values: Mapping[str, Any]) -> DataFrame:
    """The table with ``values`` in the rows that match; write it to a new place and swap."""
    hit = F.coalesce(condition(filters), F.lit(False))
    return source.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)).cast(source.schema[c].dataType) for c, v in values.items()})


def delete(source: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """The table without the rows that match; rows for which a filter is null stay."""
    return source.where(~F.coalesce(condition(filters), F.lit(False)))


def export(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of several tables as JSON: ``table``, ``row``."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def save_analysis(results: DataFrame, folder: str) -> None:
    """One analysis run as three tables (resumes, job targets, analyses) from one plan; rows carry ids made from content."""
    for name, columns in {"resumes": ["resume_id", "user_id", "resume", "file_hash"], "job_targets": ["job_id", "user_id", "job", "jd_hash"], "analyses": ["id", "user_id", "resume_id", "job_id", "scores", "report", "content_hash", "created_at"]}.items():
        insert(results.select(*columns).distinct() if name != "analyses" else results.select(*columns), f"{folder}/{name}")


def binary_files(spark: SparkSession, path: str, max_bytes: int = 8 << 20) -> DataFrame:
    """Files of a folder as ``path``, ``length``, ``content`` and ``reject``; oversize ones are listed without content. Spark's reader itself leaves empty files out."""
    files = spark.read.format("binaryFile").load(path)
    reject = F.when(F.col("length") > max_bytes, "too_large")
    return files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"), reject.alias("reject"))


def schema_ddl(df: DataFrame) -> str:
    """The schema as DDL, for export."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

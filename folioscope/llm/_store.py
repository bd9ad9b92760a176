"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of rows that goes to a Python worker: rows can be long, so their number bounds nothing.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where the setting is absent (tests, local runs) a temporary folder is made
    and the setting is filled in, so that one session uses one folder.
    """
    found = spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are bounded by bytes, unless it says how already."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join by sorting, none of whose sides goes through the driver.

    Spark takes a pinned table for as large as its compressed files and doesn't count
    what explode makes of it, so that it would broadcast tables of many times its limit.
    """
    return df.hint("merge")


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in a whole column: sizes bucket counts from the data."""
    from pyspark.sql import functions as F

    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])

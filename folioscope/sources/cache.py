"""The page cache: results of pages, kept beyond a run.

One Parquet table keyed by document, page and a hash of the settings, so that
results of other settings are never taken for this run's.  Each run appends a
version of the pages it worked on; the latest version counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rstrip, strip
from ..operators.summary import STAT

SCHEMA = f"doc_id string, text string, {STAT}, version timestamp, settings string"


def settings_key(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_cache(pages: DataFrame, path: str, settings: str) -> None:
    """Appends results: text ends in one line feed, whatever it had."""
    known = {c.split()[0]: c.split()[1] for c in STAT.split(", ")}
    columns = [(F.col(c) if c in pages.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()]
    rows = pages.select("doc_id", F.concat(rstrip(F.coalesce("text", F.lit(""))), F.lit("\n")).alias("text"), *columns)
    rows.withColumn("version", F.current_timestamp()).withColumn("settings", F.lit(settings)).write.mode("append").partitionBy("settings").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def written(pages: DataFrame, path: str) -> DataFrame:
    """``pages`` written once under ``path`` and read back, for plans that use them several times."""
    own = f"{path}/{uuid.uuid4().hex}"
    pages.write.parquet(own)
    return pages.sparkSession.read.schema(pages.schema).parquet(own)


def read_cache(spark: SparkSession, path: str, settings: str) -> DataFrame:
    """The latest result of each page, stripped; nothing if the cache isn't there yet.

    Versions are told apart by keys alone; texts are only compared among equal versions.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path).filter(F.col("settings") == settings)
    last = rows.groupBy("doc_id", "page").agg(F.max("version").alias("version"))
    latest = rows.join(last, ["doc_id", "page", "version"])
    columns = [c for c in rows.columns if c not in ("doc_id", "page")]
    one = latest.groupBy("doc_id", "page").agg(F.max_by(F.struct(*columns), "text").alias("r"))
    return one.select(*[F.col(c) if c in ("doc_id", "page") else F.col(f"r.{c}") for c in rows.columns]).withColumn("text", strip(F.col("text")))

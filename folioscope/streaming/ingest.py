"""Pages that keep coming: each micro-batch is routed and cached once.

Cross-page statistics need whole documents, so they run in batch over the cache;
the stream only turns arriving pages into cached results, and its checkpoint makes
sure that each file is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import routing
from ..sources import cache


def page_stream(spark: SparkSession, path: str, schema: str = "doc_id string, page int, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(pages: DataFrame, cache_path: str, checkpoint: str, config: Config | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Caches every arriving page with its method: text, or unknown where the text layer isn't good enough."""
    c = config or Config()
    key = cache.settings_key({"stream": c.mode})

    def take(batch: DataFrame, _: int) -> None:
        planned = routing.route(batch, mode=c.mode, min_chars=c.text_min_chars)
        done = planned.selectExpr("doc_id", "page", "text", "CASE plan WHEN 'text' THEN 'text' ELSE 'unknown' END AS method", "0D AS seconds", "length(text) AS chars", "false AS cached")
        cache.write_cache(done, cache_path, key)

    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, cache_path: str, config: Config | None = None) -> DataFrame:
    return cache.read_cache(spark, cache_path, cache.settings_key({"stream": (config or Config()).mode}))

"""Run statistics of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAT_FIELDS = ("page", "method", "seconds", "chars", "cached", "error", "model", "api_url", "warning")
STAT = "page int, method string, seconds double, chars bigint, cached boolean, error string, model string, api_url string, warning string"


def stats_from_meta(cached: DataFrame, as_cached: bool = True) -> DataFrame:
    """(doc_id, page, text, statistics) of cached pages; what the cache doesn't know gets its default."""
    default = {"method": F.lit("cached"), "seconds": F.lit(0.0), "chars": F.length("text").cast("long")}
    return cached.select("doc_id", "page", "text", *[F.coalesce(F.col(c), d).alias(c) for c, d in default.items()], F.lit(as_cached).alias("cached"), "error", "model", "api_url", "warning")


def _when(method: str) -> Column:
    return F.count_if((F.col("method") == method) & ~F.col("cached"))


def run_summary(stats: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """One row for each document: pages by method, cached pages, failed pages, removed paragraphs, seconds, share of ocr."""
    wrong = F.when(F.coalesce("error", F.lit("")) != "", F.col("page"))
    out = stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("method") == "text").alias("text_pages"),
        F.count_if(F.col("method") == "table").alias("table_pages"),
        F.count_if(F.col("method") == "ocr").alias("ocr_pages"),
        F.count_if(F.col("cached")).alias("cached_pages"),
        F.sort_array(F.collect_list(wrong)).alias("error_pages"),
        F.sum("seconds").alias("elapsed_seconds"),
    )
    worked = F.col("text_pages") + F.col("ocr_pages") + F.col("table_pages")
    out = out.withColumn("ocr_ratio", F.when(worked > 0, F.col("ocr_pages") / worked).otherwise(0.0))
    if removed is None:
        return out.withColumn("dedupe_removed", F.lit(0).cast("long"))
    return out.join(removed, "doc_id", "left").withColumn("dedupe_removed", F.coalesce("dedupe_removed", F.lit(0).cast("long")))


def stat_json(columns: dict[str, Column] | None = None) -> Column:
    """A page's statistics as JSON, nulls written out."""
    columns = columns or {c: F.col(c) for c in STAT_FIELDS}
    return F.to_json(F.struct(*[columns[c].alias(c) for c in STAT_FIELDS]), {"ignoreNullFields": "false"})

"""Which pages are worked on, and how: selection, plans, retries and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import page_ranges
from ..functions.text import is_quality_error, meaningful

PLANS = ("cached", "text", "ocr")
METHODS = ("text", "table", "ocr", "error", "cached", "unknown")


def parse_pages(text: str) -> list[int]:
    """``2,20-21`` as sorted distinct pages, on the driver; anything but numbers raises ValueError."""
    found: set[int] = set()
    for part in (text or "").replace(",", " ").split():
        a, dash, b = part.partition("-")
        low, high = sorted((int(a), int(b) if dash else int(a)))
        found.update(range(low, high + 1))
    return sorted(p for p in found if p > 0)


def selected(page: Column, include: str = "", skip: str = "") -> Column:
    """A predicate that reaches the scan: included (or all, if none is named) and not skipped."""
    wanted, unwanted = parse_pages(include), parse_pages(skip)
    keep = page.isin(wanted) if wanted else page >= 1
    return keep & ~page.isin(unwanted) if unwanted else keep


def select_pages(pages: DataFrame, include: str = "", skip: str = "") -> DataFrame:
    return pages.filter(selected(F.col("page"), include, skip))


def require_pages(pages: DataFrame) -> DataFrame:
    """``pages``, or an error if there is none."""
    if pages.isEmpty():
        raise RuntimeError("The page lists leave nothing to work on.")
    return pages


def select_by_column(pages: DataFrame, include: Column, skip: Column) -> DataFrame:
    """Selection where each row names its own ranges."""
    wanted = page_ranges(include)
    keep = (F.size(wanted) == 0) | F.array_contains(wanted, F.col("page"))
    return pages.filter(keep & ~F.array_contains(page_ranges(skip), F.col("page")))


def route(pages: DataFrame, cache: DataFrame | None = None, mode: str = "auto", resume: bool = False, retry_failed: bool = False, **limits) -> DataFrame:
    """``pages`` with ``plan``: cached (a usable result is there), text (the text layer is good) or ocr.

    The cache is joined by its keys and error only, never by its texts.
    """
    found: Column = F.lit(False)
    if cache is not None and resume:
        known = cache.select("doc_id", "page", F.lit(True).alias("_hit"), F.coalesce(F.col("error"), F.lit("")).alias("_error"))
        pages = pages.join(known, ["doc_id", "page"], "left")
        found = F.coalesce(F.col("_hit"), F.lit(False))
        if retry_failed:
            found = found & (F.col("_error") == "")
    text = {"text": F.lit(True), "ocr": F.lit(False)}.get(mode, meaningful(F.col("text"), **limits))
    plan = F.when(found, "cached").when(text, "text").otherwise("ocr")
    return pages.withColumn("plan", plan).drop("_hit", "_error")


def intercept_tables(planned: DataFrame, tables: DataFrame, only: bool = False, placeholder: str = "[Empty page]") -> DataFrame:
    """Pages due for ocr whose tables are known become method ``table``; with ``only`` the others get a placeholder.

    ``tables`` is (doc_id, page, table_text); adds ``method``, null while open.
    """
    known = planned.join(tables.select("doc_id", "page", "table_text"), ["doc_id", "page"], "left")
    hit = (F.col("plan") == "ocr") & (F.coalesce("table_text", F.lit("")) != "")
    rest = (F.col("plan") == "ocr") & F.lit(only)
    method = F.when(F.col("plan") == "text", "text").when(F.col("plan") == "cached", "cached").when(hit | rest, "table")
    text = F.when(hit, F.col("table_text")).when(rest, F.lit(placeholder)).otherwise(F.col("text"))
    return known.withColumn("method", method).withColumn("text", text).drop("table_text")


def dry_run(planned: DataFrame) -> DataFrame:
    """(doc_id, plan, n): what would be done."""
    return planned.groupBy("doc_id", "plan").agg(F.count(F.lit(1)).alias("n"))


def pending(pages: DataFrame, cache: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Pages without a result yet; with ``retry_failed`` those whose result is an error too."""
    done = cache.filter("error IS NULL OR error = ''") if retry_failed else cache
    return pages.join(done.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


_STATS = "struct<summary:struct<error_pages:array<int>>,pages:array<struct<page:int,error:string,stats:struct<page:int,error:string>>>>"


def failed_in_stats(stats: DataFrame) -> DataFrame:
    """(doc_id, page) of failed pages, from statistics as JSON in ``stats``: the summary's list, else the pages' errors."""
    parsed = stats.select("doc_id", F.from_json("stats", _STATS).alias("s"))
    listed = F.coalesce("s.summary.error_pages", F.array().cast("array<int>"))
    wrong = F.filter("s.pages", lambda p: F.coalesce(p["stats"]["error"], p["error"], F.lit("")) != "")
    pages = F.when(F.size(listed) > 0, listed).otherwise(F.transform(wrong, lambda p: F.coalesce(p["page"], p["stats"]["page"])))
    return parsed.select("doc_id", F.explode(pages).alias("page")).filter("page > 0").distinct()


def failed_in_cache(cache: DataFrame) -> DataFrame:
    """(doc_id, page) of cached results that are errors."""
    return cache.filter("error IS NOT NULL AND error <> ''").select("doc_id", "page").distinct()


def by_quality(errors: DataFrame) -> DataFrame:
    """``errors`` with whether their message is about quality, and so worth a finer image."""
    return errors.withColumn("quality_error", is_quality_error(F.col("error")))

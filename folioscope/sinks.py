"""Outputs: merged Markdown, a file for each page, and JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import page_name, rstrip, strip
from .operators.summary import stat_json


_PAGE = re.compile(r"\{page(?::(0?)(\d*)d?)?\}")


def page_header(template: str, page: Column) -> Column:
    """The template with its page filled in: ``{page}``, or with a width as in ``{page:03d}`` or ``{page:4}``; doubled braces are single ones."""
    parts, at = [], 0
    for m in _PAGE.finditer(template):
        number = page.cast("string")
        if m[2]:
            width = int(m[2])
            number = F.when(F.length(number) < width, F.lpad(number, width, "0" if m[1] else " ")).otherwise(number)
        parts += [F.lit(_braces(template[at : m.start()])), number]
        at = m.end()
    return F.concat(*parts, F.lit(_braces(template[at:])))


def _braces(text: str) -> str:
    return text.replace("{{", "{").replace("}}", "}")


def merge_pages(pages: DataFrame, separator: str = "\n\n---\n\n", header: str = "## Page {page}", title: str = "") -> DataFrame:
    """(doc_id, markdown): each document's pages in order, separators between them only."""
    head = F.concat(page_header(header, F.col("page")), F.lit("\n\n")) if header else F.lit("")
    body = F.when(F.coalesce("text", F.lit("")) != "", F.concat("text", F.lit("\n"))).otherwise("")
    pieces = F.array_sort(F.collect_list(F.struct("page", F.concat(head, body).alias("piece"))))
    merged = pages.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), separator).alias("markdown"))
    return merged.withColumn("markdown", F.concat(F.lit(f"# {title}\n\n"), F.col("markdown"))) if title else merged


def page_files(pages: DataFrame, header: str = "") -> DataFrame:
    """(doc_id, page, name, content) of each page's own file."""
    total = pages.groupBy("doc_id").agg(F.max("page").alias("_total"))
    text = F.coalesce("text", F.lit(""))
    if header:
        text = strip(F.concat(page_header(header, F.col("page")), F.lit("\n\n"), text))
    named = pages.join(total, "doc_id").withColumn("name", page_name(F.col("page"), F.col("_total")))
    return named.select("doc_id", "page", "name", F.concat(rstrip(text), F.lit("\n")).alias("content"))


def write_merged(pages: DataFrame, path: str, **how) -> None:
    """A text file for each document, in a folder named by it."""
    merge_pages(pages, **how).withColumnRenamed("markdown", "value").repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)


def write_page_files(pages: DataFrame, path: str, header: str = "") -> None:
    """A text file for each page, in folders by document and name."""
    files = page_files(pages, header).select("doc_id", "name", F.regexp_replace("content", r"\n\z", "").alias("value"))
    files.repartition("doc_id", "name").write.mode("overwrite").partitionBy("doc_id", "name").text(path)


#: Between a character of ASCII and one beyond it.
_BORDER = r"(?<=[\x00-\x7f])(?=[^\x00-\x7f])|(?<=[^\x00-\x7f])(?=[\x00-\x7f])"


def ascii_escaped(text: Column) -> Column:
    r"""JSON with everything beyond ASCII as \uXXXX, astral characters as pairs; only runs of either kind are held apart."""
    beyond = F.transform(F.split(text, _BORDER), lambda run: F.when(run.rlike(r"\A[^\x00-\x7f]"), _escape(run)).otherwise(run))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(beyond, "")).otherwise(text)


def _escape(run: Column) -> Column:
    units = F.hex(F.encode(run, "UTF-16BE"))
    return F.lower(F.regexp_replace(units, "(.{4})", r"\\u$1"))


def result_json(pages: DataFrame, summary: DataFrame, config: dict) -> DataFrame:
    """(doc_id, json): settings, summary and pages with their statistics, nulls written, ASCII only."""
    stats = [c for c in ("page", "method", "seconds", "chars", "cached", "error", "model", "api_url", "warning") if c in pages.columns]
    page = F.struct("page", F.coalesce("text", F.lit("")).alias("text"), F.struct(*stats).alias("stats"))
    keep = {"ignoreNullFields": "false"}
    # Pages are written and escaped where they lie, so that a document's row is all that is as long as a document.
    piece = F.concat(F.lit(","), ascii_escaped(F.to_json(page, keep)))
    told = F.concat(F.lit('{"config":' + json.dumps(config, default=str) + ',"summary":'), F.to_json(F.struct(*[c for c in summary.columns if c != "doc_id"]), keep), F.lit(',"pages":['))
    heads = summary.select("doc_id", ascii_escaped(told).alias("head"))
    rows = pages.select("doc_id", F.struct(F.col("page").alias("at"), piece.alias("piece")).alias("page")).unionByName(heads, allowMissingColumns=True)
    listed = rows.groupBy("doc_id").agg(F.max("head").alias("head"), F.count("page").alias("n"), F.array_sort(F.collect_list("page"))["piece"].alias("pieces")).filter("n > 0")
    first, rest = F.expr("substring(pieces[0], 2)"), F.expr("slice(pieces, 2, size(pieces))")
    body = F.concat_ws("", "head", first, rest, F.lit("]}"))  # of the right length at once
    return listed.select("doc_id", F.when(F.col("head").isNotNull(), body).alias("json"))


def stats_json(pages: DataFrame, summary: DataFrame, config: dict) -> DataFrame:
    """(doc_id, json): ``result_json`` without texts."""
    page = pages.withColumn("stat", stat_json())
    listed = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "stat"))).alias("pages"), F.sort_array(F.collect_list("page")).alias("selected"))
    told = summary.select("doc_id", F.struct(*[c for c in summary.columns if c != "doc_id"]).alias("summary"))
    body = F.concat(
        F.lit('{"config":' + json.dumps(config, default=str) + ',"selected_pages":'), F.to_json("selected"),
        F.lit(',"summary":'), F.to_json("summary", {"ignoreNullFields": "false"}),
        F.lit(',"pages":['), F.array_join(F.transform("pages", lambda x: x["stat"]), ","), F.lit("]}"),
    )
    return listed.join(told, "doc_id", "left").select("doc_id", ascii_escaped(body).alias("json"))

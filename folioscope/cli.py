"""Command line: ``python -m folioscope.cli INPUT --out FOLDER ...``."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import config as settings
from . import sinks
from .operators.ocr import http_transport
from .plans.pipeline import convert, load_prompt, reader_of
from .sources import pages as pages_in


@dataclass(frozen=True)
class Adapters:
    """What opens PDF files, and what carries requests; tests and other libraries put in their own."""

    text: pages_in.PdfAdapter = pages_in.pdfplumber_pages
    geometry: pages_in.GeometryAdapter | None = pages_in.pdfplumber_geometry
    renderer: pages_in.Renderer = pages_in.pdf2image_pages
    backends: list | None = None
    transport: Callable = http_transport


def main(argv: list[str] | None = None, spark: SparkSession | None = None, adapters: Adapters | None = None) -> int:
    """A folder of PDF files, or one file, is opened by the adapters; anything else is a table of pages."""
    source, c = settings.from_args(argv)
    use = adapters or Adapters()
    spark = spark or SparkSession.builder.appName("folioscope").getOrCreate()
    files = geometry = reader = None
    if c.source == "pdf" or c.source == "auto" and source.lower().endswith(".pdf"):
        files = pages_in.pdf_files(spark, source)
        pages = pages_in.read_pdfs(spark, source, use.text, include=c.pages)
        needs_words = c.layout == "auto" and c.mode != "text" or c.postprocess and c.remove_hf and c.hf_use_layout
        geometry = pages_in.read_geometry(files, use.geometry, c.pages) if use.geometry and needs_words else None
    else:
        pages = pages_in.read_pages(spark, source)
    providers = c.providers(os.environ.get("FOLIOSCOPE_API_KEY", "")) if c.mode != "text" else ()
    if providers:
        reader = reader_of(c.settled(), providers, load_prompt(spark, c.prompt_file), transport=use.transport)
    out = convert(spark, pages, c, c.cache_dir or f"{c.out or source}.cache", reader, geometry=geometry, files=files, renderer=use.renderer, backends=use.backends)
    if c.dry_run:
        if not c.quiet:
            out.summary.orderBy("doc_id", "plan").show(truncate=False)
        return 0
    head = c.page_header if c.include_page_header else ""
    if c.out and c.merge:
        sinks.write_merged(out.pages, c.out, separator=c.separator, header=head, title=c.title if c.include_title else "")
    if c.per_page_dir:
        sinks.write_page_files(out.pages, c.per_page_dir, c.page_header if c.page_header_in_pages else "")
    snapshot = c.snapshot(input=source)
    if c.json_out:
        sinks.result_json(out.pages, out.summary, snapshot).write.mode("overwrite").json(c.json_out)
    if c.stats_out:
        sinks.stats_json(out.pages, out.summary, snapshot).write.mode("overwrite").json(c.stats_out)
    if c.config_out:
        spark.createDataFrame([(json.dumps(snapshot, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(c.config_out)
    if not c.quiet:
        out.summary.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

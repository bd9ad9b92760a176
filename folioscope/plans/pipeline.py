"""The engine's two main plans: cleaning pages, and converting documents."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as t
from ..functions.tables import tables_markdown
from ..operators import crosspage, hooks, images, layout, ocr, routing, summary
from ..operators.reflow import reflow_column
from ..operators.replacements import apply_rules, load_rules
from ..sources import cache as cached
from ..sources import pages as pages_in

Rules = list[tuple[str, str]]


def clean_pages(pages: DataFrame, config: Config | None = None, rules: Rules | None = None, sigs: DataFrame | None = None, pre_hook: hooks.Hook | None = None, post_hook: hooks.Hook | None = None) -> DataFrame:
    """(doc_id, page, text, method, warning, n_removed): the clean-up chain.

    Normalize; find headers and footers, if ``sigs`` doesn't name them; then for each
    page the pre-hook, header removal, dehyphenation, reflow, replacements, headings,
    normalizing again and the post-hook; then repeated paragraphs go, and short pages
    get their note.  Without ``postprocess`` only normalizing, hooks and the note.
    Headers are found before the pre-hook has its say.  Null texts count as empty.
    """
    c = config or Config()
    method = F.col("method") if "method" in pages.columns else F.lit("unknown")
    page = pages.select("doc_id", "page", t.normalize(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(method, F.lit("unknown")).alias("method"))
    edges = {"top": c.hf_top, "bottom": c.hf_bottom, "strip_digits": c.hf_strip_digits}
    if c.postprocess and c.remove_hf and sigs is None:
        sigs = crosspage.detect_headers_footers(page, ratio=c.hf_min_ratio, least=c.hf_min_pages, **edges)
    page = hooks.apply_hook(page, pre_hook or c.pre_hook, "pre", c.continue_on_error)
    text = F.col("text")
    if c.postprocess:
        if c.remove_hf:
            page = crosspage.remove_headers_footers(page, sigs, page_numbers=c.remove_page_number, **edges)
        if c.dehyphenate:
            text = t.dehyphenate(text)
        if c.reflow:
            page, text = crosspage.computed(page.withColumn("text", reflow_column(text)), _text=F.col("text")).drop("text").withColumnRenamed("_text", "text"), F.col("text")
        text = apply_rules(text, rules or [], c.replace_mode, c.replace_ignore_case)
        if c.auto_headings:
            text = t.auto_headings(text, c.heading_level, c.heading_max_len)
    page = page.withColumn("text", t.normalize(text))
    page = hooks.apply_hook(page, post_hook or c.post_hook, "post", c.continue_on_error)
    if c.postprocess and c.dedupe:
        page = crosspage.dedupe_paragraphs(page, c.dedupe_min_ratio, c.dedupe_min_pages, c.dedupe_min_chars, c.dedupe_strip_digits)
    else:
        page = page.withColumn("n_removed", F.lit(0).cast("long"))
    noted = t.short_warning(F.col("text"), c.warn_short, c.warn_prefix, c.empty_placeholder)
    page = crosspage.computed(page, _noted=noted)
    return page.select("doc_id", "page", F.col("_noted.text").alias("text"), "method", F.col("_noted.warning").alias("warning"), "n_removed")


@dataclass(frozen=True)
class Conversion:
    """What a conversion gives: pages with texts and statistics, and a summary of each document."""

    pages: DataFrame
    summary: DataFrame
    planned: DataFrame
    config: Config

    def merged(self) -> DataFrame:
        from .. import sinks

        c = self.config
        return sinks.merge_pages(self.pages, c.separator, c.page_header if c.include_page_header else "", c.title if c.include_title else "")


#: Settings that change a page's raw text, and so what its cached result is good for.
_MATTERS = (
    "mode", "text_min_chars", "text_min_alnum_ratio", "text_min_avg_line", "text_max_blank_ratio", "model", "dpi", "table_mode", "table_backend", "table_flavor", "table_header",
    "preprocess", "denoise", "denoise_size", "contrast", "binarize", "binarize_threshold", "deskew", "layout", "split_blocks", "imgfmt", "max_side", "prompt_file", "prompt_lang",
)


def load_prompt(spark: SparkSession, path: str) -> str | None:
    """The prompt template in a file, stripped, or nothing if no file is named; a missing file is an error."""
    if not path:
        return None
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    if not rows:
        raise FileNotFoundError(path)
    return rows[0].value.strip()


def reader_of(config: Config, providers: tuple[ocr.Provider, ...], template: str | None = None, **more) -> ocr.Reader:
    """A reader as the settings have it."""
    c = config
    limits = {"quality": c.ocr_quality, "min_chars": c.ocr_min_chars, "min_alnum": c.ocr_min_alnum_ratio, "max_symbol": c.ocr_max_symbol_ratio, "max_replaced": c.ocr_max_replace_ratio}
    tries = {"continuations": c.max_continuations, "retries": c.max_retries, "page_retries": c.page_retries, "sleep_base": c.sleep_base, "rps": c.ocr_rps}
    return ocr.Reader(providers, c.models(), detail=c.detail, timeout=c.timeout, max_tokens=c.max_tokens, temperature=c.temperature, template=template, **limits, **tries, **more)


def look_of(config: Config) -> images.Look:
    """How pages' images are prepared, as the settings have it."""
    c = config
    preparation = {
        "enabled": c.preprocess, "straighten": c.deskew, "most": c.deskew_max_angle, "step": c.deskew_step, "median": c.denoise, "size": c.denoise_size,
        "factor": c.contrast, "black_white": c.binarize, "at": c.binarize_threshold,
    }
    block = {"gap": c.block_gap_ratio, "least": c.block_min_ratio, "ink": c.block_ink_ratio, "white": c.block_white_threshold, "most": c.block_max_blocks}
    return images.Look(c.dpi, c.dpi_high, c.max_side, c.imgfmt, tuple(preparation.items()), c.column_overlap, c.split_blocks, tuple(block.items()), c.ocr_max_pixels, c.ocr_min_side, c.ocr_skip_large)


def failed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page) of the failed pages that an earlier run's statistics name."""
    rows = spark.read.json(path)
    return routing.failed_in_stats(rows.select("doc_id", F.col("json").alias("stats")))


def with_splits(due: DataFrame, geometry: DataFrame | None, config: Config) -> DataFrame:
    """``due`` with ``split``: where a page's two columns part, as the layout setting and the words say."""
    c = config
    limits = {"gap": c.column_gap_ratio, "min_words": c.column_min_words, "left": c.column_left_ratio, "right": c.column_right_ratio}
    if c.layout != "auto" or geometry is None:
        ratio = F.lit(float(c.column_split)) if c.layout == "columns" else F.lit(None).cast("double")
        return due.withColumn("split", ratio)
    decided = layout.decide_layout(F.col("words"), F.col("width"), c.layout, c.column_split, **limits)
    found = geometry.select("doc_id", "page", decided["split_ratio"].alias("split"))
    return due.join(found, ["doc_id", "page"], "left")


def tables_of(files: DataFrame, planned: DataFrame, config: Config, backends: list | None = None) -> DataFrame:
    """(doc_id, page, table_text) of the pages due for reading that hold tables."""
    c = config
    due = planned.filter("plan = 'ocr'").select("doc_id", "page")
    found = pages_in.extract_tables(files, due, backends or pages_in.backends(c.table_backend, c.table_flavor))
    return found.filter(F.size("tables") > 0).select("doc_id", "page", tables_markdown(F.col("tables"), c.table_header).alias("table_text"))


def kept_images(spark: SparkSession, files: DataFrame, due: DataFrame, config: Config, renderer: pages_in.Renderer, path: str) -> DataFrame:
    """Images of the due pages in the image cache, rendered now where it lacks them."""
    c = config
    for dpi in dict.fromkeys([c.dpi, c.dpi_high] if c.adaptive_dpi else [c.dpi]):
        there = spark.read.schema(pages_in.IMAGES).parquet(path) if cached.exists(spark, path) else None
        lacking = due.select("doc_id", "page")
        if there is not None:
            lacking = lacking.join(there.filter((F.col("dpi") == dpi) & F.col("pixels").isNotNull()).select("doc_id", "page"), ["doc_id", "page"], "left_anti")
        made = pages_in.render_pages(files, lacking.repartition(max(1, c.render_workers), "doc_id", "page"), renderer, dpi)
        made.write.mode("append").parquet(path)
    return spark.read.schema(pages_in.IMAGES).parquet(path).dropDuplicates(["doc_id", "page", "dpi"])


def convert(
    spark: SparkSession, source: DataFrame, config: Config, cache_path: str, reader: ocr.Reader | None = None, load=None, tables: DataFrame | None = None, geometry: DataFrame | None = None,
    files: DataFrame | None = None, renderer: pages_in.Renderer = pages_in.pdf2image_pages, backends: list | None = None,
) -> Conversion:
    """Routes, reads, caches and cleans all selected pages of ``source`` (doc_id, page, text).

    Pages that need reading go to ``reader``: by ``load``, if one is given, else as
    images that ``renderer`` makes of ``files`` (doc_id, content).  What is found is
    written to the cache before anything is cleaned, so a lost run costs only pages not
    yet written, and no page is read twice because a plan was recomputed.  ``tables`` is
    (doc_id, page, table_text), by default what ``backends`` find in ``files``;
    ``geometry`` has pages with words, for layout headers and columns.  Cleaned pages
    are written beside the cache, so that hooks run once for each page.
    """
    c = config.settled()
    key = cached.settings_key({k: v for k, v in dataclasses.asdict(c).items() if k in _MATTERS})
    known = cached.read_cache(spark, cache_path, key)
    pages = routing.select_pages(source, c.pages, c.skip_pages)
    retried = c.retry_failed or bool(c.retry_failed_from)
    if retried:
        failed = failed_pages(spark, c.retry_failed_from) if c.retry_failed_from else routing.failed_in_cache(known)
        pages = pages.join(failed, ["doc_id", "page"], "left_semi")
    limits = {"min_chars": c.text_min_chars, "min_alnum_ratio": c.text_min_alnum_ratio, "min_avg_line": c.text_min_avg_line, "max_blank_ratio": c.text_max_blank_ratio}
    language = t.language_hint(F.col("text")) if c.auto_lang and not c.prompt_lang else F.lit(c.prompt_lang)
    planned = routing.route(pages, known, c.mode, c.resume or retried, retried, **limits).withColumn("language", language)
    if c.dry_run:
        return Conversion(pages.limit(0), routing.dry_run(planned), planned, c)
    if tables is None and files is not None and c.table_mode != "off":
        tables = tables_of(files, planned, c, backends)
    none = spark.createDataFrame([], "doc_id string, page int, table_text string")
    routed = routing.intercept_tables(planned, tables if tables is not None and c.table_mode != "off" else none, c.table_mode == "only", c.empty_placeholder)
    shown = F.when(F.coalesce("text", F.lit("")) == "", c.empty_placeholder).otherwise(F.col("text"))
    done = routed.withColumn("text", F.when(F.col("method") == "text", shown).otherwise(F.col("text"))).filter("method IN ('text', 'table')")
    local = done.select("doc_id", "page", "text", "method")
    cached.write_cache(local.withColumn("seconds", F.lit(0.0)).withColumn("chars", F.length("text")).withColumn("cached", F.lit(False)), cache_path, key)
    # What is due is what the cache doesn't hold by now: tables needn't be looked for again.
    held = cached.read_cache(spark, cache_path, key).filter("method IN ('text', 'table')").select("doc_id", "page")
    due = planned.filter("plan = 'ocr'").join(held, ["doc_id", "page"], "left_anti")
    finer = c.adaptive_dpi and c.dpi_high > c.dpi
    if reader is not None and load is None and files is not None:
        open_pages = with_splits(due, geometry, c)
        images_of = kept_images(spark, files, due, c, renderer, f"{cache_path}.images") if c.cache_images else None
        read = ocr.read_scans(files, open_pages, reader, look_of(c), renderer, c.ocr_workers, finer, images_of)
    elif reader is not None and load is not None:
        read = ocr.read_pages(due, reader, load, c.ocr_workers, finer)
    elif due.isEmpty():
        read = None
    else:
        raise RuntimeError("Some pages need reading by a service, and no reader, or nothing to read them from, is set up.")
    if read is not None:
        cached.write_cache(read.withColumn("cached", F.lit(False)), cache_path, key)
    chosen = source if retried else pages
    fresh = planned.select("doc_id", "page", (F.col("plan") == "cached").alias("_old"))
    results = cached.read_cache(spark, cache_path, key).join(chosen.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    stats = summary.stats_from_meta(results, False).join(fresh, ["doc_id", "page"], "left").withColumn("cached", F.coalesce("_old", F.lit(True))).drop("_old")
    sigs = None
    if geometry is not None and c.postprocess and c.remove_hf and c.hf_use_layout:
        sigs = layout.detect_layout_headers_footers(geometry, c.hf_top_margin, c.hf_bottom_margin, c.hf_min_ratio, c.hf_min_pages, c.hf_strip_digits, c.hf_font_max_ratio, c.hf_line_tolerance)
    clean = clean_pages(stats.select("doc_id", "page", "text", "method"), c, load_rules(spark, c.replace_file), sigs)
    clean = cached.written(clean, f"{cache_path}.clean")
    told = stats.drop("text", "warning", "method").join(clean, ["doc_id", "page"])
    removed = clean.groupBy("doc_id").agg(F.sum("n_removed").alias("dedupe_removed"))
    return Conversion(told, summary.run_summary(told, removed), planned, c)

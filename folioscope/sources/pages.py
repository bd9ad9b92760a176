"""Tables of pages: from text tables, and from PDF files through adapters.

The PDF libraries are optional and injected: an adapter is a callable on a file's
bytes, run in Arrow batches on the executors, one file at a time.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.layout import GEOMETRY
from ..operators.routing import parse_pages

PAGES = "doc_id string, page int, text string"


class PdfAdapter(Protocol):
    """A file's bytes and wanted pages (none: all) to pages' texts; null text is empty."""

    def __call__(self, content: bytes, pages: list[int]) -> Iterator[tuple[int, str | None]]: ...


def pdfplumber_pages(content: bytes, pages: list[int]) -> Iterator[tuple[int, str | None]]:
    """Text layers by pdfplumber, where that is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            if not pages or n in pages:
                yield n, page.extract_text(x_tolerance=2, y_tolerance=2)


def read_pdfs(spark: SparkSession, path: str, adapter: PdfAdapter = pdfplumber_pages, include: str = "") -> DataFrame:
    """Pages of all files under ``path``; the page list goes into the reader, for no filter gets through it."""
    wanted = parse_pages(include)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, n, t or "") for n, t in adapter(content, wanted)]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, PAGES).withColumn("text", normalize(F.col("text")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that lie as rows in Parquet; null texts become empty."""
    rows = spark.read.parquet(path)
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("page", F.col("page").cast("int")).withColumn("text", F.coalesce("text", F.lit("")))


def number_pages(rows: DataFrame, document: str, order: str, text: str = "text") -> DataFrame:
    """(doc_id, page, text) of any table that has a document column and an order within it.

    Only keys are ranked within a document, whatever its length; texts are dealt out
    by document and order, and those of equal order are numbered among themselves.
    Rows without an order come first.
    """
    keys = [F.col(document).alias("_document"), F.col(order).alias("_order")]
    many = rows.select(*keys).groupBy("_document", "_order").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_document").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.select(F.col("_document").alias("_d"), F.col("_order").alias("_o"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = Window.partitionBy("_document", "_order").orderBy("text")
    met = rows.select(*keys, F.col(text).alias("text")).join(starts, F.col("_document").eqNullSafe(F.col("_d")) & F.col("_order").eqNullSafe(F.col("_o")))
    page = F.col("_start") + F.row_number().over(same)
    return met.select(F.col("_document").cast("string").alias("doc_id"), page.cast("int").alias("page"), "text")


#: Pages for which a file is shipped and opened once.
PAGES_PER_CHUNK = 16


def in_chunks(files: DataFrame, wanted: DataFrame, columns: list[str], keep: bool = False) -> DataFrame:
    """(doc_id, content, pages): files met by up to ``PAGES_PER_CHUNK`` of their wanted pages at a time, as structs of ``columns``.

    ``keep``: pages of files that aren't there come with null content.
    """
    chunk = wanted.groupBy("doc_id", F.floor(F.col("page") / PAGES_PER_CHUNK).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("pages"))
    return chunk.join(files.select("doc_id", "content"), "doc_id", "left" if keep else "inner").select("doc_id", "content", "pages")


class GeometryAdapter(Protocol):
    """A file's bytes and wanted pages (none: all) to (page, width, height, words, chars) as ``operators.layout`` has them."""

    def __call__(self, content: bytes, pages: list[int]) -> Iterator[tuple[int, float, float, list[dict], list[dict]]]: ...


def pdfplumber_geometry(content: bytes, pages: list[int]) -> Iterator[tuple[int, float, float, list[dict], list[dict]]]:
    """Words and characters with coordinates by pdfplumber, where that is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            if not pages or n in pages:
                words = [{k: w[k] for k in ("text", "x0", "x1", "top", "bottom")} for w in page.extract_words(x_tolerance=2, y_tolerance=2)]
                yield n, float(page.width), float(page.height), words, [{"size": c["size"], "top": c["top"]} for c in page.chars]


def read_geometry(files: DataFrame, adapter: GeometryAdapter = pdfplumber_geometry, include: str = "") -> DataFrame:
    """Page geometry of ``files`` (doc_id, content); a file that can't be read has none."""
    wanted = parse_pages(include)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["doc_id"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in adapter(content, wanted)], columns=["doc_id", "page", "width", "height", "words", "chars"])

    return files.select("doc_id", "content").mapInPandas(run, GEOMETRY)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of the PDF files under ``path``, named as ``read_pdfs`` names them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


Renderer = Callable[[bytes, int, int], np.ndarray]
IMAGES = "doc_id string, page int, dpi int, width int, height int, pixels binary, error string"


def pdf2image_pages(content: bytes, page: int, dpi: int) -> np.ndarray:
    """A page in colour by pdf2image, where that is installed."""
    from pdf2image import convert_from_bytes

    found = convert_from_bytes(content, dpi=dpi, first_page=page, last_page=page)
    if not found:
        raise RuntimeError(f"there is no page {page}")
    return np.asarray(found[0])


def render_pages(files: DataFrame, wanted: DataFrame, renderer: Renderer, dpi: int = 300) -> DataFrame:
    """Images of the wanted pages: (doc_id, page, dpi, width, height, pixels, error).

    ``files`` is (doc_id, content), ``wanted`` (doc_id, page).  A page without an
    image is an error in its row.
    """
    chunks = in_chunks(files, wanted, ["page"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content, page in _each(batch):
                try:
                    gray = renderer(content, page, dpi)
                    rows.append((name, page, dpi, gray.shape[1], gray.shape[0], np.ascontiguousarray(gray, np.uint8).tobytes(), None))
                except Exception as e:
                    rows.append((name, page, dpi, None, None, None, f"no image of page {page}: {e}"))
            out = pd.DataFrame(rows, columns=["doc_id", "page", "dpi", "width", "height", "pixels", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return chunks.mapInPandas(run, IMAGES)


def _each(batch: pd.DataFrame) -> Iterator[tuple[str, bytes, int]]:
    for name, content, pages in zip(batch["doc_id"], batch["content"], batch["pages"], strict=True):
        for p in pages:
            yield name, content, int(p["page"])


def render_or_reuse(files: DataFrame, wanted: DataFrame, renderer: Renderer, cache: DataFrame | None, dpi: int = 300) -> DataFrame:
    """Images from the cache (keyed by document, page and resolution) where it has them, rendered otherwise."""
    if cache is None:
        return render_pages(files, wanted, renderer, dpi)
    known = cache.filter((F.col("dpi") == dpi) & F.col("pixels").isNotNull())
    keys = ["doc_id", "page"]
    reused = known.join(wanted.select(*keys), keys, "left_semi").select("doc_id", "page", "dpi", "width", "height", "pixels", "error")
    return reused.unionByName(render_pages(files, wanted.join(known.select(*keys), keys, "left_anti"), renderer, dpi))


TableBackend = Callable[[bytes, int], list[list[list[str]]]]


def camelot_tables(flavor: str = "lattice") -> TableBackend:
    def read(content: bytes, page: int) -> list[list[list[str]]]:
        import tempfile

        import camelot

        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
            f.write(content)
            f.flush()
            return [t.df.astype(str).values.tolist() for t in camelot.read_pdf(f.name, pages=str(page), flavor=flavor)]

    return read


def tabula_tables(lattice: bool = True) -> TableBackend:
    def read(content: bytes, page: int) -> list[list[list[str]]]:
        import tabula

        found = tabula.read_pdf(io.BytesIO(content), pages=page, lattice=lattice, multiple_tables=True)
        return [[list(map(str, t.columns)), *t.astype(str).values.tolist()] for t in found]

    return read


def backends(name: str = "auto", flavor: str = "lattice") -> list[tuple[str, TableBackend]]:
    """Table readers in the order in which they are tried."""
    known = {"camelot": camelot_tables(flavor), "tabula": tabula_tables(flavor == "lattice")}
    return list(known.items()) if name == "auto" else [(name, known[name])]


def extract_tables(files: DataFrame, wanted: DataFrame, tried: list[tuple[str, TableBackend]]) -> DataFrame:
    """(doc_id, page, backend, tables): of the first backend that doesn't raise, even if it finds nothing."""
    chunks = in_chunks(files, wanted, ["page"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content, page in _each(batch):
                tables, used = [], None
                for backend, read in tried:
                    try:
                        tables, used = read(content, page), backend
                        break
                    except Exception:  # the next one may do
                        continue
                rows.append((name, page, used, tables))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "backend", "tables"])

    return chunks.mapInPandas(run, "doc_id string, page int, backend string, tables array<array<array<string>>>")

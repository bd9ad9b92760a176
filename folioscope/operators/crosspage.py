"""Statistics across a document's pages: headers, footers and repeated paragraphs.

Pages are rows of (doc_id, page, text).  Only signatures are shuffled: at most
``top + bottom`` lines of a page, or its long paragraphs' signatures, counted with
map-side partial aggregation on (doc_id, signature), so that a huge document is
spread over as many tasks as it has signatures.  What passes a threshold is a
handful of rows for a document; that small side meets the pages in a join that
Catalyst broadcasts only while it is small.  Texts never travel to be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import threshold
from ..functions.text import blank, is_page_number, lines, paragraphs, signature, strip


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once.

    Catalyst folds projections into one, and so would repeat an expensive column
    in every lambda that names it; it doesn't fold through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


def _numbered(text: Column) -> Column:
    """Non-blank lines with their places among all lines."""
    return F.filter(F.transform(lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda s: ~blank(s["line"]))


def _head(items: Column, n: int) -> Column:
    return F.slice(items, 1, n) if n > 0 else F.slice(items, 1, 0)


def _tail(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n) if n > 0 else F.slice(items, 1, 0)


def detect_headers_footers(pages: DataFrame, top: int = 2, bottom: int = 2, ratio: float = 0.6, least: int = 3, strip_digits: bool = True) -> DataFrame:
    """(doc_id, kind, sig, n): lines that stand at the top or bottom of enough pages; occurrences are counted."""
    edge = lambda kind, part: F.transform(part, lambda s: F.struct(F.lit(kind).alias("kind"), signature(s["line"], strip_digits).alias("sig")))
    own = computed(pages.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), own=_numbered(F.col("text"))).drop("text")
    seen = own.select("doc_id", F.inline(F.concat(edge("header", _head(F.col("own"), top)), edge("footer", _tail(F.col("own"), bottom)))))
    counted = seen.filter("sig <> ''").groupBy("doc_id", "kind", "sig").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(page_counts(pages), "doc_id").filter(F.col("n") >= threshold(F.col("n_pages"), ratio, least)).select("doc_id", "kind", "sig", "n")


def _by_document(sigs: DataFrame) -> DataFrame:
    """Signatures as arrays; thresholds leave a few for each document."""
    pick = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("sig")))
    return sigs.groupBy("doc_id").agg(pick("header").alias("header_sigs"), pick("footer").alias("footer_sigs"))


def remove_headers_footers(pages: DataFrame, sigs: DataFrame, top: int = 2, bottom: int = 2, strip_digits: bool = True, page_numbers: bool = True) -> DataFrame:
    """``pages`` without the edge lines named in ``sigs``, and without page numbers; a page may become empty."""
    none = F.array().cast("array<string>")
    listed = _by_document(sigs)
    known = pages.join(listed, "doc_id", "left").withColumn("header_sigs", F.coalesce("header_sigs", none)).withColumn("footer_sigs", F.coalesce("footer_sigs", none))

    def gone(zone: Column, these: str) -> Column:
        hit = lambda s: F.array_contains(F.col(these), signature(s["line"], strip_digits))
        drop = (lambda s: hit(s) | is_page_number(s["line"])) if page_numbers else hit
        return F.transform(F.filter(zone, drop), lambda s: s["i"])

    known = computed(known, _own=_numbered(F.col("text")))
    known = computed(known, _lines=lines(F.col("text")), _gone=F.concat(gone(_head(F.col("_own"), top), "header_sigs"), gone(_tail(F.col("_own"), bottom), "footer_sigs")))
    kept = F.filter("_lines", lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = strip(F.array_join(kept, "\n"))
    if not page_numbers:  # nothing to look for leaves a page untouched, white space and all
        text = F.when((F.size("header_sigs") == 0) & (F.size("footer_sigs") == 0), F.col("text")).otherwise(text)
    return known.withColumn("text", text).drop("_own", "_lines", "_gone", "header_sigs", "footer_sigs")


def repeated_paragraphs(pages: DataFrame, ratio: float = 0.6, least: int = 3, min_chars: int = 80, strip_digits: bool = True) -> DataFrame:
    """(doc_id, sig, n): long paragraphs that stand on enough pages; each page counts once."""
    long = F.filter(paragraphs(F.coalesce("text", F.lit(""))), lambda p: F.length(p) >= min_chars)
    sigs = F.array_distinct(F.transform(long, lambda p: signature(p, strip_digits)))
    counted = pages.select("doc_id", F.explode(sigs).alias("sig")).groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(page_counts(pages), "doc_id").filter(F.col("n") >= threshold(F.col("n_pages"), ratio, least)).select("doc_id", "sig", "n")


def dedupe_paragraphs(pages: DataFrame, ratio: float = 0.6, least: int = 3, min_chars: int = 80, strip_digits: bool = True) -> DataFrame:
    """``pages`` without any copy of repeated paragraphs, and ``n_removed``; a page may become empty."""
    sigs = repeated_paragraphs(pages, ratio, least, min_chars, strip_digits).groupBy("doc_id").agg(F.collect_set("sig").alias("_sigs"))
    known = pages.join(sigs, "doc_id", "left").withColumn("_sigs", F.coalesce("_sigs", F.array().cast("array<string>")))
    all_of = computed(known, _all=paragraphs(F.col("text")))
    kept = F.filter("_all", lambda p: (F.length(p) < min_chars) | ~F.array_contains(F.col("_sigs"), signature(p, strip_digits)))
    cut = computed(all_of, _kept=kept)
    return cut.withColumn("text", F.array_join("_kept", "\n\n")).withColumn("n_removed", (F.size("_all") - F.size("_kept")).cast("long")).drop("_sigs", "_all", "_kept")

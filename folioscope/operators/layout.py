"""Layout of pages from words with coordinates.

Words are rows of a page table: (doc_id, page, width, height, words, chars), words
an array of (text, x0, x1, top, bottom), chars an array of (size, top).  A page's
lines are a fold over its words; they stay in the row, as array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import median_of, threshold
from ..functions.text import signature, strip
from .crosspage import page_counts

GEOMETRY = (
    "doc_id string, page int, width double, height double,"
    " words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>,"
    " chars array<struct<size:double,top:double>>"
)
BLOCK = "struct<text:string,top:double,bottom:double,size:double>"
_WORD = "struct<top:double,x0:double,bottom:double,text:string>"


def line_blocks(words: Column, chars: Column, tolerance: float = 3.0) -> Column:
    """ARRAY<STRUCT<text, top, bottom, size>> of a page's lines.

    Words go down the page; one belongs to the line while its top is within
    ``tolerance`` of the line's first word's.  A line's size is the median of the
    character sizes whose tops are near its bottom, else the page's median.
    """
    key = F.transform(words, lambda w: F.struct(w["top"], w["x0"], w["bottom"], w["text"]))
    empty = F.array().cast(f"array<array<{_WORD}>>")

    def add(groups: Column, word: Column) -> Column:
        last = F.element_at(groups, -1)
        near = F.abs(word["top"] - last[0]["top"]) <= tolerance
        grown = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.concat(last, F.array(word))))
        return F.when(F.size(groups) == 0, F.array(F.array(word))).when(near, grown).otherwise(F.concat(groups, F.array(F.array(word)))).cast(f"array<array<{_WORD}>>")

    groups = F.aggregate(F.array_sort(key).cast(f"array<{_WORD}>"), empty, add)
    sized = F.filter(chars, lambda c: c["size"] != 0)
    sizes = lambda cs: F.transform(cs, lambda c: c["size"])

    def block(line: Column) -> Column:
        across = F.array_sort(F.transform(line, lambda w, i: F.struct(w["x0"], i, w["text"].alias("text"))))
        bottom = F.array_max(F.transform(line, lambda w: w["bottom"]))
        near = F.filter(sized, lambda c: (c["top"] >= bottom - tolerance) & (c["top"] <= bottom + tolerance))
        return F.struct(
            strip(F.array_join(F.transform(across, lambda w: F.coalesce(w["text"], F.lit(""))), " ")).alias("text"),
            F.array_min(F.transform(line, lambda w: w["top"])).alias("top"),
            bottom.alias("bottom"),
            median_of(sizes(F.when(F.size(near) > 0, near).otherwise(sized))).alias("size"),
        )

    return F.transform(groups, block)


def two_columns(words: Column, width: Column, gap: float = 0.08, min_words: int = 20, left: float = 0.45, right: float = 0.55) -> Column:
    """Where a page's two columns part, as a share of its width, or null; words across the middle don't count."""
    left_max = F.array_max(F.transform(F.filter(words, lambda w: w["x1"] <= width * left), lambda w: w["x1"]))
    right_min = F.array_min(F.transform(F.filter(words, lambda w: w["x0"] >= width * right), lambda w: w["x0"]))
    found = (F.size(words) >= min_words) & (width > 0) & (right_min - left_max >= width * gap)
    return F.when(found, (left_max + right_min) / 2 / width)


def decide_layout(words: Column, width: Column, mode: str = "auto", split: float = 0.5, **limits) -> Column:
    """STRUCT<mode, split_ratio>: single, columns, or whatever the words say."""
    if mode == "single":
        return F.struct(F.lit("single").alias("mode"), F.lit(None).cast("double").alias("split_ratio"))
    if mode == "columns":
        return F.struct(F.lit("columns").alias("mode"), F.lit(float(split)).alias("split_ratio"))
    found = two_columns(words, width, **limits)
    return F.struct(F.when(found.isNull(), "single").otherwise("columns").alias("mode"), found.alias("split_ratio"))


def detect_layout_headers_footers(
    pages: DataFrame, top: float = 0.12, bottom: float = 0.12, ratio: float = 0.6, least: int = 3, strip_digits: bool = True, font_max: float = 0.9, tolerance: float = 3.0
) -> DataFrame:
    """(doc_id, kind, sig, n): lines in the top or bottom band of enough pages, larger print left out."""
    lined = pages.filter("height > 0").select("doc_id", "height", line_blocks(F.col("words"), F.col("chars"), tolerance).alias("b"))
    usual = median_of(F.transform(F.filter("b", lambda x: x["size"] != 0), lambda x: x["size"]))
    rows = lined.select("doc_id", "height", usual.alias("usual"), F.explode("b").alias("b")).filter("b.text <> ''")
    if font_max > 0:
        rows = rows.filter(~((F.col("usual") != 0) & (F.col("b.size") > F.col("usual") * font_max)))
    bands = F.array_compact(F.array(
        F.when(F.col("b.bottom") <= F.col("height") * top, "header"),
        F.when(F.col("b.top") >= F.col("height") * (1.0 - bottom), "footer"),
    ))
    seen = rows.select("doc_id", F.explode(bands).alias("kind"), signature(F.col("b.text"), strip_digits).alias("sig")).filter("sig <> ''")
    counted = seen.groupBy("doc_id", "kind", "sig").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(page_counts(pages), "doc_id").filter(F.col("n") >= threshold(F.col("n_pages"), ratio, least)).select("doc_id", "kind", "sig", "n")

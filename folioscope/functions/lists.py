"""Lists in text, page ranges, medians and sizes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip


def split_csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), strip), lambda x: x != "")


def unique(items: Column) -> Column:
    """Distinct items in the order of their first places."""
    return F.array_distinct(items)


def page_ranges(text: Column) -> Column:
    """``2,20-21`` as a sorted array of distinct pages; bounds in either order; pages from 1.

    A part that isn't a number or two fails the query.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), rf",|{WS}", -1), lambda p: p != "")

    def pages(part: Column) -> Column:
        ends = F.transform(F.split(part, "-", 2), lambda x: strip(x).cast("int"))
        a, b = ends[0], F.element_at(ends, -1)
        return F.sequence(F.least(a, b), F.greatest(a, b))

    return F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))), lambda p: p > 0)


def median(values: Column) -> Column:
    """The exact median of an aggregate's values; 0.0 of none."""
    return F.coalesce(F.percentile(values, 0.5), F.lit(0.0))


def median_of(values: Column) -> Column:
    """The exact median of an array; 0.0 of an empty one."""
    v, n = F.array_sort(values), F.size(values)
    mid = F.floor(n / 2).cast("int")
    high = F.get(v, mid)
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, high).otherwise((F.get(v, mid - 1) + high) / 2).cast("double")


def limited_side(width: Column, height: Column, max_side: int, max_pixels: int, min_side: int = 600) -> Column:
    """The longest side at which an image keeps to ``max_pixels``, but not below ``min_side``."""
    pixels = width.cast("long") * height
    scaled = F.greatest(F.lit(min_side), F.floor(max_side * F.sqrt(max_pixels / pixels)).cast("int"))
    return F.when((pixels > max_pixels) & F.lit(max_pixels > 0), scaled).otherwise(F.lit(max_side))


def threshold(pages: Column, ratio: float, least: int) -> Column:
    """How many pages must agree: a ceiling with a little slack below."""
    return F.greatest(F.lit(least).cast("long"), F.floor(pages.cast("double") * F.lit(float(ratio)) + F.lit(0.999)).cast("long"))

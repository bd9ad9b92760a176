"""Extracted tables as Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(rows: Column, header: bool = True) -> Column:
    """ARRAY<ARRAY<STRING>> as a pipe table; ragged rows are padded, cells are not escaped, null cells read None."""
    width = F.array_max(F.transform(rows, F.size))

    def even(row: Column) -> Column:
        cells = F.transform(row, lambda c: strip(F.coalesce(c, F.lit("None"))))
        return F.concat(cells, F.array_repeat(F.lit(""), width - F.size(row)))

    full = F.transform(rows, even)
    numbered = F.when(width > 0, F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.concat(F.lit("col"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    head = F.element_at(full, 1) if header else numbered
    body = F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))) if header else full
    text = F.array_join(F.concat(F.array(_row(head), _row(F.array_repeat(F.lit("---"), width))), F.transform(body, _row)), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(text)


def tables_markdown(tables: Column, header: bool = True) -> Column:
    """A page's tables, a blank line between them."""
    shown = F.transform(tables, lambda t: table_markdown(t, header))
    return F.coalesce(F.array_join(F.filter(shown, lambda t: t != ""), "\n\n"), F.lit(""))

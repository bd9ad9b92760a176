"""Paragraph reflow: an ordered fold over one page's lines.

A line joins the paragraph before it or not depending on what that paragraph has
become, so the fold is sequential and runs in an Arrow UDF, page by page; its
state is one paragraph.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import END_PUNCT

_FENCE = "```"
_SOLID = re.compile(r"\s*(?:[#>|]|```|[-*_]{3,}\s*\Z|(?:[-*+]|\d+[.)])\s)|\s{4,}\S")


def reflow(text: str | None) -> str | None:
    """One page: broken lines joined to paragraphs; code, lists, tables and blank lines kept."""
    if text is None:
        return None
    done: list[str] = []
    open_paragraph: str | None = None
    fenced = False
    for raw in text.splitlines():
        body = raw.strip()
        fence = body.startswith(_FENCE)
        plain = bool(body) and not (fence or fenced or _SOLID.match(raw))
        if plain and open_paragraph is not None and not (_SOLID.match(open_paragraph) or open_paragraph.endswith(tuple(END_PUNCT))):
            open_paragraph += " " + body
            continue
        if open_paragraph is not None:
            done.append(open_paragraph)
        open_paragraph = body if plain else None
        if not plain:
            done.append(raw.rstrip())
            fenced ^= fence
    if open_paragraph is not None:
        done.append(open_paragraph)
    return "\n".join(done).strip()


def reflow_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(reflow, na_action="ignore")

    return run(text)

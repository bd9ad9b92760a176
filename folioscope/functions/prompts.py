"""Prompts for the page reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The prompt's text: fixed values.
OPENING = "You are a high-accuracy OCR engine. Extract all text from the image and output Markdown."
LANGUAGE = "Language hint: %s"
RULES = (
    "Requirements:",
    "1) Preserve reading order (top to bottom, left to right; multi-column left then right).",
    "2) Preserve paragraphs and line breaks as much as possible; use #/##/### for headings.",
    "3) Reconstruct tables as Markdown tables when possible; otherwise use aligned plain text.",
    "4) Do not invent content; use [??] for unreadable characters.",
    "5) Output only the final Markdown, no explanations or code fences.",
)
PAGE = "(This is page %d.)"


def prompt(page: Column, language: Column, template: str | None = None) -> Column:
    """The default prompt, or a template with {page} and {language} filled in; other braces stay."""
    hint = F.coalesce(language, F.lit(""))
    if template:
        shown = F.replace(F.lit(template), F.lit("{page}"), page.cast("string"))
        return strip(F.replace(shown, F.lit("{language}"), hint))
    named = F.when(hint != "", F.format_string(LANGUAGE, hint))
    return F.concat_ws("\n", F.lit(OPENING), named, F.lit("\n".join(RULES)), F.format_string(PAGE, page.cast("int")))

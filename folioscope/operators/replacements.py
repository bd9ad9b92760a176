"""Ordered text replacements: rules from a file or table, applied as chained expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What may stand between the two sides of a rule, the first one found wins: fixed values.
DELIMITERS = ("=>", "->", "\t")


def parse_rules(text: str) -> list[tuple[str, str]]:
    """Rules of a replacement file; blank lines, # comments and lines without delimiter are no rules."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        delimiter = next((d for d in DELIMITERS if d in line), None)
        if line and not line.startswith("#") and delimiter:
            before, _, after = line.partition(delimiter)
            rules.append((before.strip(), after.strip()))
    return rules


def load_rules(spark: SparkSession, path: str | None) -> list[tuple[str, str]]:
    """Rules of a (small) file in any store Spark reads; no path, no rules; a missing file fails."""
    if not path:
        return []
    return parse_rules(spark.read.text(path, wholetext=True).first()[0])


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _literal(template: str) -> str:
    """What a replacement template stands for, quoted for Java: escapes such as \\n are read once, here."""
    return re.sub(r"([\\$])", r"\\\1", re.compile("x").sub(template, "x"))


def apply_rules(text: Column, rules: list[tuple[str, str]], mode: str = "plain", ignore_case: bool = False) -> Column:
    """All rules in order, each on what the one before left.

    Plain rules replace literally; word rules want word boundaries on both sides.
    Where a rule becomes a pattern (word mode, or no case) its right side is read
    as a template with backslash escapes.  Rules without a left side do nothing.
    """
    for before, after in rules:
        if not before:
            continue
        if mode == "word" or ignore_case:
            edge = r"\b" if mode == "word" else ""
            flags = "(?iuU)" if ignore_case else "(?U)"
            text = F.regexp_replace(text, f"{flags}{edge}{_quoted(before)}{edge}", _literal(after))
        else:
            text = F.replace(text, F.lit(before), F.lit(after))
    return text

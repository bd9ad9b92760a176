"""Scalar text functions: Column in, Column out, all inside the JVM.

White space is what Unicode and the C0 separators make it (29 code points), not
the six characters of Java's ``\\s``; ends of text are ``\\z``, for ``$`` also
matches before a last line feed.  Null text gives null unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: single characters are cheaper to look up than categories.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_IN_LINE = r"\t\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same in Java's regular expressions, with and without the line feed.
WS = rf"[\n{_IN_LINE}]"
WS_IN_LINE = f"[{_IN_LINE}]"
#: Line ends as text files know them, beyond the line feed.
LINE_END = r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Sentence ends behind which lines aren't joined: fixed values.
END_PUNCT = ".?!;:。！？；："
ALNUM = r"a-zA-Z0-9\p{L}\p{N}"  # the first three are looked up faster
#: White space that ends no line, between two ends of lines: a blank line.
BLANK_LINE = rf"{LINE_END}(?=[\t\r \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*+{LINE_END})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Line feeds only, at most one blank line, no white space at line ends or around the text.

    Blank lines are collapsed before line ends are trimmed, so lines of spaces
    can leave longer gaps; a second pass would close them.
    """
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, rf"{WS_IN_LINE}++(?=\n|\z)", "")
    return strip(text)


def lines(text: Column) -> Column:
    """The lines of a text; a last line end opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, -1))


def blank(text: Column) -> Column:
    return ~text.rlike(rf"[^\n{_IN_LINE}]")


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def _count(text: Column, outside: str) -> Column:
    """Characters left when the runs that match ``outside`` are dropped: runs, for every match has its price."""
    return F.length(F.regexp_replace(text, outside, ""))


def text_metrics(text: Column) -> Column:
    """STRUCT<total_chars, alnum_ratio, avg_line_len, blank_ratio> of the normalized text; null counts as empty."""

    def measure(text: Column) -> Column:
        ends = F.length(text) - F.length(F.regexp_replace(text, LINE_END, ""))
        chars, n_lines = F.length(text), F.when(text == "", 0).otherwise(ends + 1)
        empty = F.regexp_count(text, F.lit(BLANK_LINE))  # normalized text neither begins nor ends with one
        return F.struct(
            chars.alias("total_chars"),
            _ratio(_count(text, f"[^{ALNUM}]++"), chars).alias("alnum_ratio"),
            _ratio(chars - ends, n_lines).alias("avg_line_len"),  # normalized text doesn't end in a line end
            _ratio(empty, n_lines).alias("blank_ratio"),
        )

    return let(normalize(F.coalesce(text, F.lit(""))), measure)


def meaningful(text: Column, min_chars: int = 200, min_alnum_ratio: float = 0.25, min_avg_line: float = 12.0, max_blank_ratio: float = 0.6, metrics: Column | None = None) -> Column:
    """Whether a text layer is good enough to be used as it is."""

    def good(m: Column) -> Column:
        short = (m["avg_line_len"] < min_avg_line) & (m["total_chars"] < 2 * min_chars)
        return (m["total_chars"] >= min_chars) & (m["alnum_ratio"] >= min_alnum_ratio) & ~short & (m["blank_ratio"] <= max_blank_ratio)

    return (F.coalesce(text, F.lit("")) != "") & (let(text_metrics(text), good) if metrics is None else good(metrics))


def language_hint(text: Column, sample: int = 1000, share: float = 0.4) -> Column:
    """zh, ru or en by the share of each script among the three, in that order; else empty."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, sample)
    cjk = _count(head, r"[^一-鿿㐀-䶿]++")
    cyrillic, latin = _count(head, r"[^Ѐ-ӿ]++"), _count(head, "[^A-Za-z]++")
    total = (cjk + cyrillic + latin).cast("double")
    out = F.when(total == 0, "")
    for n, name in ((cjk, "zh"), (cyrillic, "ru"), (latin, "en")):
        out = out.when(n / total >= share, name)
    return out.otherwise("")


def ocr_metrics(text: Column) -> Column:
    """STRUCT<total_chars, alnum_ratio, symbol_ratio, replacement_ratio>; null counts as empty."""

    def measure(text: Column) -> Column:
        chars = F.length(text)
        lost = chars - F.length(F.regexp_replace(text, "[�□]", ""))
        unread = (chars - F.length(F.replace(text, F.lit("[??]"), F.lit("")))) / 4
        return F.struct(
            chars.alias("total_chars"),
            _ratio(_count(text, f"[^{ALNUM}]++"), chars).alias("alnum_ratio"),
            _ratio(_count(text, rf"[{ALNUM}\n{_IN_LINE}]++"), chars).alias("symbol_ratio"),
            _ratio(lost + unread, chars).alias("replacement_ratio"),
        )

    return let(normalize(F.coalesce(text, F.lit(""))), measure)


def ocr_ok(text: Column, min_chars: int = 80, min_alnum_ratio: float = 0.2, max_symbol_ratio: float = 0.6, max_replacement_ratio: float = 0.02, metrics: Column | None = None) -> Column:
    """STRUCT<ok, reason>: the first limit that a recognised text misses."""

    def fault(m: Column) -> Column:
        return (
            F.when(m["total_chars"] < min_chars, f"total_chars<{min_chars}")
            .when(m["alnum_ratio"] < min_alnum_ratio, f"alnum_ratio<{min_alnum_ratio}")
            .when(m["symbol_ratio"] > max_symbol_ratio, f"symbol_ratio>{max_symbol_ratio}")
            .when(m["replacement_ratio"] > max_replacement_ratio, f"replacement_ratio>{max_replacement_ratio}")
            .otherwise("")
        )

    reason = let(ocr_metrics(text), fault) if metrics is None else fault(metrics)
    return let(reason, lambda r: F.struct((r == "").alias("ok"), r.alias("reason")))


def is_quality_error(message: Column) -> Column:
    return F.coalesce(F.lower(message).contains("ocr quality") | F.lower(message).contains("quality check failed"), F.lit(False))


def dehyphenate(text: Column) -> Column:
    """Joins words that a hyphen parts at a line end."""
    return F.regexp_replace(text, rf"([A-Za-z])-\n{WS}*+([a-z])", "$1$2")


def signature(text: Column, strip_digits: bool = True) -> Column:
    """A line or paragraph as it is compared across pages."""
    text = F.regexp_replace(strip(text), rf"{WS}++", " ")
    if strip_digits:
        text = F.regexp_replace(text, r"\p{Nd}+", "#")
    return F.lower(text)


_D, _S = r"\p{Nd}+", WS + "*"
_PAGE_NUMBER = "|".join((
    rf"(page{_S})?{_D}({_S}/{_S}{_D})?",
    rf"{_D}{_S}(of|/|\\){_S}{_D}",
    "[ivxlcdm]+",
    rf"第{_S}{_D}{_S}页",
    rf"第{_S}{_D}{_S}/{_S}{_D}{_S}页",
))


def is_page_number(line: Column) -> Column:
    """Lines that are nothing but a page number; roman ones can be words too."""
    return F.lower(strip(line)).rlike(rf"\A(?:{_PAGE_NUMBER})\z")


_MARK = rf"(?:[-*+]|{_D}[.)])"
BLOCK_LINE = rf"\A{WS}*(?:[#>|]|```|[-*_]{{3,}}{WS}*\z|{_MARK}{WS})|\A{WS}{{4,}}[^\n{_IN_LINE}]"


def is_block_line(line: Column) -> Column:
    """Headings, quotes, tables, rules, list items, indented and fenced code."""
    return line.rlike(BLOCK_LINE) & ~blank(line)


def may_join(before: Column, after: Column) -> Column:
    """Whether two lines can be one paragraph's."""
    return ~is_block_line(before) & ~is_block_line(after) & ~rstrip(before).rlike(rf"[{END_PUNCT}]\z")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped; empty ones are dropped."""
    return F.filter(F.transform(F.split(strip(text), rf"\n{WS}*\n", -1), strip), lambda p: p != "")


_CHAPTER = "一二三四五六七八九十百千零〇两0-9"


def heading_level(line: Column, base: int = 2, max_len: int = 80) -> Column:
    """The level that a line has as a heading, or null."""

    def level(text: Column) -> Column:
        dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
        none = (text == "") | (F.length(text) > max_len) | text.startswith("#") | text.rlike(rf"\A{_MARK}{WS}+")
        return (
            F.when(none, F.lit(None).cast("int"))
            .when(text.rlike(rf"(?U)\A第{WS}*[{_CHAPTER}]+{WS}*[章节篇]\b"), F.lit(base))
            .when(text.rlike(rf"(?i)\A(chapter|chap\.?|section){WS}+{_D}"), F.lit(base))
            .when(text.rlike(rf"\A{_D}(?:\.{_D}){{1,4}}{WS}+[^\n{_IN_LINE}]"), F.least(base + dots, F.lit(6)))
            .otherwise(F.lit(None).cast("int"))
        )

    return let(strip(line), level)


def auto_headings(text: Column, base: int = 2, max_len: int = 80) -> Column:
    """The text with its headings marked; other lines stay as they are."""

    def mark(line: Column) -> Column:
        show = lambda n: F.when(n > 0, F.concat(F.repeat(F.lit("#"), n), F.lit(" "), strip(line))).otherwise(line)
        return let(heading_level(line, base, max_len), show)

    return F.array_join(F.transform(lines(text), mark), "\n")


def short_warning(text: Column, min_chars: int, prefix: str = "[WARN]", placeholder: str = "[Empty page]") -> Column:
    """STRUCT<text, warning>: a note in front of pages under ``min_chars``; off at 0."""
    if min_chars <= 0:
        return F.struct(text.alias("text"), F.lit(None).cast("string").alias("warning"))
    note = f"{prefix} content length below {min_chars} chars"

    def noted(body: Column) -> Column:
        short = F.length(body) < min_chars
        shown = strip(F.concat(F.lit(f"> {note}\n\n"), F.when(body == "", placeholder).otherwise(body)))
        return F.struct(F.when(short, shown).otherwise(text).alias("text"), F.when(short, note).alias("warning"))

    return let(strip(F.coalesce(text, F.lit(""))), noted)


def page_name(page: Column, total: Column, extension: str = "md") -> Column:
    """page_07.md: as wide as the number of pages asks for, two digits at least."""
    extension = "jpg" if extension.lower() == "jpeg" else extension.lower()
    digits = page.cast("string")
    width = F.greatest(F.length(total.cast("string")), F.lit(2), F.length(digits))
    return F.concat(F.lit("page_"), F.lpad(digits, width, F.lit("0")), F.lit(f".{extension}"))


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")

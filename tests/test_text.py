import random
import re

import pytest

from folioscope.functions import text as t
from folioscope.operators.reflow import reflow


def test_normalize(apply):
    assert apply(t.normalize, ["a\n \n \nb", "a\r\nb\rc  \n", "\n\n a \n\n\n\nb", "", None]) == ["a\n\n\nb", "a\nb\nc", "a\n\nb", "", None]
    assert apply(lambda c: t.normalize(t.normalize(c)), ["a\n \n \nb"]) == ["a\n\nb"]


def _normalize(x):
    x = re.sub(r"\n{3,}", "\n\n", x.replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join(s.rstrip() for s in x.split("\n")).strip()


def test_random_texts_against_python(apply):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab1-#>|* \n\t  \x1c\x85　.一二`", k=rng.randint(0, 40))) for _ in range(400)]
    assert apply(t.normalize, texts) == [_normalize(x) for x in texts]
    assert apply(lambda c: t.lines(t.normalize(c)), texts) == [_normalize(x).splitlines() for x in texts]
    sig = [re.sub(r"\d+", "#", re.sub(r"\s+", " ", x.strip())).lower() for x in texts]
    assert apply(t.signature, texts) == sig
    parts = [[p.strip() for p in re.split(r"\n\s*\n", x.strip()) if p.strip()] for x in texts]
    assert apply(t.paragraphs, texts) == parts


def test_dehyphenate(apply):
    assert apply(t.dehyphenate, ["exam-\nple", "A-\nB", "a-\n  b", "a-\nb-\nc"]) == ["example", "A-\nB", "ab", "ab-\nc"]


def test_page_numbers(apply):
    yes = ["Page 3", "3 / 9", "3 of 9", "xiv", "第 3 页", "第3/9页", "mix", " 12 "]
    no = ["page x", "", "3 9", "第页", "12a", None]
    assert apply(t.is_page_number, yes) == [True] * len(yes)
    assert not any(apply(t.is_page_number, no))


def test_block_lines(apply):
    yes = ["# a", "> a", "| a", "---", "***  ", "- a", "3. a", "3) a", "    code", "```x", "  - a", "- "]
    no = ["", "-a", "a # b", "3.a", "   x", "--", None]
    assert apply(t.is_block_line, yes) == [True] * len(yes)
    assert not any(apply(t.is_block_line, no))


def test_headings(apply):
    cases = {"1.1 Intro": 3, "Chapter 4": 2, "chap. 2": 2, "1. item": None, "第一章 绪论": 2, "第一章绪论": None, "1.1 a.b.c": 5, "# x": None, "": None, "1.1.1.1.1 x": 6, "x" * 81: None, "section 9 " + "y" * 90: None}
    assert apply(t.heading_level, list(cases)) == list(cases.values())
    assert apply(t.auto_headings, ["1.1 Intro\ntext\n Chapter 4"]) == ["### 1.1 Intro\ntext\n## Chapter 4"]


def test_language(apply):
    texts = ["一二三四" + "a" * 6, "Привет", "123", "", "hello", None, "a" * 1000 + "一" * 900]
    assert apply(t.language_hint, texts) == ["zh", "ru", "", "", "en", "", "en"]


def test_text_gate(apply):
    line = "word " * 10
    texts = ["", "x" * 199, "x" * 200, "." * 300, "ab\n" * 80, "ab\n" * 200, line * 6, None]
    assert apply(t.meaningful, texts) == [False, False, True, False, False, True, True, False]


def test_ocr_gate(apply):
    got = apply(t.ocr_ok, ["short", "." * 100, "a#" * 60 + "#" * 60, "ab" * 50 + "[??]" * 3, "ab" * 50])
    assert [g.reason for g in got] == ["total_chars<80", "alnum_ratio<0.2", "symbol_ratio>0.6", "replacement_ratio>0.02", ""]
    assert [g.ok for g in got] == [False] * 4 + [True]
    m = apply(t.ocr_metrics, ["[??] �a□"])[0]
    assert m.total_chars == 8 and abs(m.replacement_ratio - 3 / 8) < 1e-12


def test_short_warning(apply):
    assert apply(lambda c: t.short_warning(c, 0), ["x"])[0].warning is None
    got = apply(lambda c: t.short_warning(c, 5), ["  ", "abc", "abcdef", None])
    note = "[WARN] content length below 5 chars"
    assert [g.text for g in got] == [f"> {note}\n\n[Empty page]", f"> {note}\n\nabc", "abcdef", f"> {note}\n\n[Empty page]"]
    assert [g.warning for g in got] == [note, note, None, note]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("-\nfoo\nbar", "- foo\nbar"), ("a\nb", "a b"), ("a.\nb", "a.\nb"), ("a。\nb", "a。\nb"), ("```\na\n  b\n```\nc\nd", "```\na\n  b\n```\nc d"),
        ("a\n\nb", "a\n\nb"), ("a\n# h\nb", "a\n# h\nb"), ("", ""), ("a\n    code\nb", "a\n    code\nb"), (None, None),
    ],
)
def test_reflow(text, want):
    assert reflow(text) == want


def test_quality_error(apply):
    assert apply(t.is_quality_error, ["OCR quality check failed: x", "timeout", None]) == [True, False, False]

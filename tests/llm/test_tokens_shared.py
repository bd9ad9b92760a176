"""Words are encoded once, whatever their case and the marks behind them, and no text's ids change by that."""

import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import _tokens

ODD = [
    "Don't DON'T 'S a'S's it's'. ''s '' x,'y' (Él) «É,» É, ÑÜ!! ß. Łódź; Ёлка, ёлка. İ, i̇. ǅ, ŉ, ſ. ×, ÷. 3, ٣, ½, 4.5.6 a.b@c.de",
    "J̌, ǰ H̱. é, É! a⃝, ≠ =, ≮",
    "<|ENDOFTEXT|> <|endoftext|> a<|startoftext|>b, A<|StartOfText|>B. <|endoftext",
    "日本語, テキスト。 a\x85b, a\x1cb. a b,  x, Σς, ΑΣ. K, Å. 한국, \U0001f600, a\U0001f600. _a_ a_b, $$$ ***",
    "",
    ", a",
    "Word",
]


def whole(path, texts, special):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() for t in texts])]


def test_words_are_encoded_once():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéñöж", k=9)) for _ in range(200)]
    texts = [" ".join(f(w) + mark for w in words) for f in (str, str.upper, str.title) for mark in ("", ".", ",", "***")]
    own = _tokens.Encoder(_tokens.default_path(), False, "<u4")
    assert ids(own, texts) == whole(_tokens.default_path(), texts, False)
    # letters beyond ASCII keep their case until a word is encoded
    assert len(own._kept) <= 3 * len(words) + 3


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("rows, piece", [(600_000, 1 << 18), (4, 1 << 18), (600_000, 20), (4, 1)])
def test_ids_are_those_of_whole_texts(monkeypatch, special, rows, piece):
    monkeypatch.setattr(_tokens, "CACHE_ROWS", rows)
    monkeypatch.setattr(_tokens, "_PIECE", piece)
    own = _tokens.Encoder(_tokens.default_path(), special, "<u4")
    texts = [*ODD, " ".join(ODD[:1] * 3), *(a + p + b for a in "aZ7éÉжİ×ª日" for p in "'.,|-" for b in ("", "s", "S", "RE", "é", "1", "́", "̸"))]
    for _ in range(2):
        assert ids(own, texts) == whole(_tokens.default_path(), texts, special)
        assert [x for t in texts for x in ids(own, [t])] == whole(_tokens.default_path(), texts, special)
    assert own.ids([]) == [] and own.ids([b""]) == [b""]


def test_other_files(tmp_path):
    with open(_tokens.default_path(), encoding="utf-8") as f:
        found = json.load(f)
    cased = found | {"normalizer": {"type": "NFC"}}
    letters = found | {"added_tokens": [{**found["added_tokens"][0], "content": "sep"}]}
    for name, kind in (("cased", cased), ("letters", letters)):
        path = str(tmp_path / f"{name}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(kind, f)
        texts = ["Word, word. WORD separate", "SEP, sep."]
        assert ids(_tokens.Encoder(path, False, "<u4"), texts) == whole(path, texts, False)

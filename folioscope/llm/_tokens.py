"""Token ids of texts by a public tokenizer, with a cache of words.

The tokenizer's file is a parameter.  Its split never joins characters across
ASCII white space, so a text's ids are the ids of its runs of other characters,
one after another; each distinct run is encoded once and kept while it fits in
the cache.  ``tests/llm`` holds the ids against whole-text encoding.

Where the file states the steps ``_STEPS``, texts are put in lower case and spaces
put before punctuation behind a letter or digit first, which changes no ids: words
then meet again in any case and before any mark, and a word of ``_LETTERS`` needs
the file's model only.  Texts where that could change ids (marks that join letters,
added tokens in any case), and all texts of other files, stay as they are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np

from . import _text as tx

CACHE_ROWS = 600_000
#: New runs encoded in one call.
_TOGETHER = 256
VOCABULARY = "word_bpe_49k.json"

#: Bytes of text worked on at a time, however long a text is.
_PIECE = 1 << 18
_SPACE = re.compile(rb"[\t-\r ]")

#: Letters that NFC leaves alone beside each other and whose lower case is one letter: ASCII, U+00C0-U+017F but for the
#: signs of multiplication and division and U+0130, and U+0400-U+047F.
_LETTERS = re.compile(rb"[A-Za-z]*(?:(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5\xd0\xd1][\x80-\xbf])+[A-Za-z]*)+")
#: First bytes of U+0300-U+037F, among them all marks that NFC can join with an ASCII letter.
_MARKS = (b"\xcc", b"\xcd")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
#: ASCII letters and digits, and whatever may end a letter of ``_LETTERS``.
_BEFORE = tx.ALNUM.copy()
_BEFORE[0xC0:] = False
_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    def __init__(self, path: str, special_as_text: bool, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._dtype = np.dtype(dtype)
        self._words, self._ends, self._apart = _word_tokenizer(self._tokenizer)
        self._kept: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as packed little-endian integers."""
        out, group, size = [], [], 0
        for text in texts:
            if size + len(text) > _PIECE:
                out += self._ids(group)
                group, size = [], 0
            if len(text) > _PIECE:
                out.append(b"".join(self._ids([piece])[0] for piece in _pieces(text)))
            else:
                group.append(text)
                size += len(text)
        return out + self._ids(group)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        rows = self._runs(texts)
        runs = list(chain.from_iterable(rows))
        found = list(map(self._kept.get, runs))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            self._learn({runs[i] for i in new}, runs)
            for i in new:
                found[i] = self._kept[runs[i]]
        ends = list(accumulate(map(len, rows), initial=0))
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _runs(self, texts: list[bytes]) -> list[list[bytes]]:
        """Runs of each text whose ids are the text's."""
        if self._words is None:
            return [t.split() for t in texts]
        whole = b"\n".join(texts).lower()
        if any(x in whole for x in self._apart):
            return [t.split() for t in texts] if len(texts) == 1 else [self._runs([t])[0] for t in texts]
        data = np.frombuffer(whole, np.uint8)
        at = np.flatnonzero(_PUNCTUATION[data[1:]] & _BEFORE[data[:-1]])
        wide = np.flatnonzero(data[at] >= 0x80)
        ends = [bool(_LETTERS.fullmatch(whole[max(i - 1, 0) : i + 1])) for i in at[wide].tolist()]
        at = np.delete(at, wide[~np.array(ends, bool)]) + 1
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        offsets = (offsets + np.searchsorted(at, offsets)).tolist()
        whole = np.insert(data, at, 0x20).tobytes()
        return [whole[a:b].split() for a, b in zip(offsets, offsets[1:], strict=False)]

    def _learn(self, new: set[bytes], runs: list[bytes]) -> None:
        """Encodes runs that aren't kept; all ``runs`` are kept afterwards."""
        if len(self._kept) + len(new) > CACHE_ROWS:
            self._kept.clear()
            new = set(runs)
        words = [] if self._words is None else [r for r in new if r.isalpha() or _LETTERS.fullmatch(r)]
        for part, encode in ((words, self._encode_words), (list(new.difference(words)), self._encode)):
            for i in range(0, len(part), _TOGETHER):
                self._kept.update(encode(part[i : i + _TOGETHER]))

    def _encode(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Runs, as one text with spaces between them; each id's offset tells whose it is."""
        words = [r.decode("utf-8", "replace") for r in runs]
        found = self._tokenizer.encode(" ".join(words), add_special_tokens=False)
        begin = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        first = np.cumsum([0, *(len(w) + 1 for w in words)])
        return self._cut(runs, found.ids, np.searchsorted(begin, first))

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words, as one text with spaces between them; the last id of each tells that it is."""
        found = self._words.encode_batch_fast([b" ".join(words).decode().lower()], add_special_tokens=False)[0].ids
        cuts = np.flatnonzero(self._ends[found]) + 1
        return self._cut(words, found, np.concatenate([[0], cuts])) if len(cuts) == len(words) else self._encode(words)

    def _cut(self, runs: list[bytes], ids: list[int], cuts: np.ndarray) -> dict[bytes, bytes]:
        raw = np.array(ids, self._dtype).tobytes()
        cut = (cuts * self._dtype.itemsize).tolist()
        return {r: raw[a:b] for r, a, b in zip(runs, cut, cut[1:], strict=False)}


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text, cut at white space."""
    a = 0
    while a < len(text):
        found = _SPACE.search(text, a + _PIECE)
        b = found.end() if found else len(text)
        yield text[a:b]
        a = b


def _word_tokenizer(tokenizer):
    """(model behind a split at spaces, which ids end a word, byte strings whose texts stay as they are), if the tokenizer's steps are ``_STEPS``."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    parts = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.post_processor
    if tuple(p and json.loads(p.__getstate__()) for p in parts) != _STEPS or not isinstance(tokenizer.model, models.BPE):
        return None, None, ()
    suffix, added = tokenizer.model.end_of_word_suffix, tokenizer.get_added_tokens_decoder().values()
    if not suffix or any(t.normalized or _LETTERS.fullmatch(t.content.encode()) or t.content.isalpha() for t in added):
        return None, None, ()
    words = Tokenizer(tokenizer.model)
    words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = words.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return words, ends, (*_MARKS, *(t.content.encode().lower() for t in added))


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False, dtype: str = "<u4") -> Encoder:
    """One encoder for each Python worker and set of options."""
    return Encoder(path, special_as_text, dtype)


def forget() -> None:
    """Gives back what encoders keep in this worker: workers outlive a query, and what comes next needs the memory."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        tx.release()

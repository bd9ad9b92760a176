"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a text with a word; notices that are wrapped over several
lines are looked for in a second view, in runs of such lines.  A paragraph's features are hashed word 1- and
2-grams, scaled by the root of their number; a softmax regression, trained in
numpy, gives a probability for each licence family, for ``unknown`` (talk of
licences that names no known family) and for ``none``.  A temperature fitted on
held-out examples calibrates it, and what it then calls a family with less than
``CONFIDENT`` probability is ``unknown`` as well.  Short notices whose telling words
are replaced by invented names stand for families that no template knows, in
training and in calibration.  A predicted family is confirmed
when the paragraph holds enough of one of the family's templates, in order of
words; unconfirmed predictions count as ``unknown``.

The second view holds each ``SPANS`` of consecutive lines, and each whole run of lines
between lines without a word.  Only families that such a stretch confirms count, the
shortest and surest first, where no line or stretch in it holds that family
already; the unconfirmed lines in it are part of the notice then.  A stretch is
numbered by its first line.

The training paragraphs are made by rule, with a fixed seed: templates with words
dropped, names and years put in and words around them, licence talk, and prose of
common and invented words (``PER_CLASS`` of each family, three times as many of prose, eight times as many of
licence talk, most of it by invented names); no row is read for it.

For most paragraphs the full softmax is not needed: the sum of each feature's
largest advantage of any class over ``none`` bounds them all, and where that bound
stays below zero ``none`` is the answer.

Null and empty texts have no paragraphs.  Rows with null or equal ids are scanned
one by one; empty tables give empty results; other columns are never looked at.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from . import _text as tx

PER_CLASS = 240
CONFIDENT = 0.6
CONFIRMED = 0.7
STEPS = 150
#: Lines of the stretches in which wrapped notices are looked for.
SPANS = (2, 3, 4, 6, 8)

#: Notices of each family: fixed values, quoted from the licences' own short forms.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3",
        "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Distributed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD license",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal", "Licensed under CC0 1.0"),
    "CC-BY": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "proprietary": ("All rights reserved. No part of this work may be reproduced without written permission", "Copyright. All rights reserved"),
}
#: Talk of licences that names no family: fixed values.
TALK = (
    "Licensed under the terms of the accompanying agreement",
    "See the license file for details",
    "This work is released under a custom license",
    "The licence of this text is not known",
    "Use of this document is subject to the license of its owner",
    "Released under an open license",
    "You may use this file under the license conditions",
    "Distributed under the terms of the vendor license",
)
_COMMON = "the of and to a in is it that for was on are as with he be this by at from or not have an they which you one we all his were de la le les des et en un une du que est pour dans der die das und ist von den mit nicht ein eine zu auf el los las y se del por con no su para es work software file version public general terms free use copy may under any part person following".split()
#: Words without meaning for licences: alone, or in pairs with each other, they are no features.
_STOP = frozenset(_COMMON[: _COMMON.index("work")])
CLASSES = ("none", "unknown", *TEMPLATES)


def _tokens(line: str) -> list[str]:
    raw = np.frombuffer(line.encode(), np.uint8)
    low = tx.LOWER[raw]
    a, b, _ = tx.words(low, np.array([0, len(raw)], np.int64), tx.ALNUM)
    return [low[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(a, b, strict=True)]


#: Templates of at most so many words name their licence and say little else.
SHORT_NOTICE = 14


def _strange() -> list[tuple[list[str], frozenset[str]]]:
    """Short notices, and which of their words only their family has: with other names there they are of unknown families."""
    held: dict[str, set[str]] = {}
    for family, texts in TEMPLATES.items():
        for w in {w for t in texts for w in _tokens(t)}:
            held.setdefault(w, set()).add(family)
    out = []
    for texts in TEMPLATES.values():
        for t in texts:
            names = {w for x in t.split()[1:] if x != x.lower() for w in _tokens(x)}
            own = frozenset(w for w in names if len(held[w]) == 1 and not w.isdigit())
            if own and len(_tokens(t)) <= SHORT_NOTICE:
                out.append((t.split(), own))
    return out


def _examples(rng: random.Random, per_class: int) -> list[tuple[str, int]]:
    def word() -> str:
        return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "st", "le", "ou", "ci", "ch", "en", "ie"]) for _ in range(rng.randint(1, 4)))

    def prose(n: int) -> list[str]:
        return [rng.choice(_COMMON) if rng.random() < 0.5 else word() for _ in range(n)]

    def vary(text: str) -> str:
        words = [w for w in text.split() if rng.random() > 0.06]
        if rng.random() < 0.3:
            words = ["Copyright", str(rng.randint(1990, 2025)), word().capitalize(), *words]
        if rng.random() < 0.4:
            words = prose(rng.randint(1, 6)) + words
        if rng.random() < 0.4:
            words += prose(rng.randint(1, 6))
        return " ".join(words)

    strange = _strange()

    def stranger() -> str:
        words, own = rng.choice(strange)
        name = [word().capitalize() for _ in range(rng.randint(1, 3))]
        renamed = [w for x in words for w in (name if own & set(_tokens(x)) else [x])]
        return vary(" ".join(renamed))

    rows = []
    for k, name in enumerate(CLASSES):
        for i in range(per_class if k > 1 else (3, 8)[k] * per_class):
            if name == "none":
                text = " ".join(prose(rng.randint(1, 60)))
            else:
                pool = TALK if name == "unknown" else TEMPLATES[name]
                text = pool[0] if i == 0 else stranger() if name == "unknown" and i % 4 else vary(pool[i // 4 % len(pool)] if name == "unknown" else pool[i % len(pool)])
            rows.append((text, k))
    return rows


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(tx.run_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


_STOP_HASHES = np.array(sorted(map(_hash, _STOP)), np.uint64)


@dataclass(frozen=True)
class Words:
    """The words of some lines, what a model makes of each of them and of each with the next."""

    first: np.ndarray
    one: np.ndarray
    two: np.ndarray

    @staticmethod
    def of(data: np.ndarray, lines: np.ndarray, model: Model) -> Words:
        low = tx.LOWER[data]
        starts, ends, first = tx.words(low, lines, tx.ALNUM)
        word = tx.run_hashes(low, starts, ends)
        telling = _STOP_HASHES[np.minimum(np.searchsorted(_STOP_HASHES, word), len(_STOP_HASHES) - 1)] != word
        one, two = np.where(telling, model.find(word), -1), np.full(len(word), -1)
        if len(word) > 1:
            two[:-1] = np.where(telling[:-1] | telling[1:], model.find(tx.gram_hashes(word, 2)[: len(word) - 1]), -1)
        return Words(first, one, two)

    def sums(self, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of the features' values over lines a to b - 1, each taken as one paragraph."""
        pad = np.concatenate([value, np.zeros_like(value[:1])])  # feature -1 is worth nothing
        i, j = self.first[a], self.first[b]
        if pad.ndim > 1:
            return self._gathered(pad, i, j)
        single, double = (np.concatenate([np.zeros_like(pad[:1], np.float64), np.cumsum(pad[x], axis=0, dtype=np.float64)]) for x in (self.one, self.two))
        return single[j] - single[i] + double[np.maximum(j - 1, i)] - double[i]


    def _gathered(self, pad: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sums of several values for each feature, over some stretches of words at a time."""
        out = np.zeros((len(i), pad.shape[1]))
        behind = np.cumsum(j - i)
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(behind, (behind[at - 1] if at else 0) + _GATHERED, "right")))
            size = j[at:to] - i[at:to]
            row = np.repeat(np.arange(to - at), size)
            word = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(i[at:to], size)
            last = word + 1 == np.repeat(j[at:to], size)
            single, double = self.one[word], np.where(last, -1, self.two[word])
            for k in range(pad.shape[1]):
                out[at:to, k] = np.bincount(row, pad[single, k] + pad[double, k], to - at)
            at = to
        return out


#: Words of stretches whose values are looked at together.
_GATHERED = 1 << 17


def _stretches(n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line behind) of all stretches of two lines or more."""
    full = n > 0
    begins = full.copy()
    begins[1:] &= ~full[:-1] | (row[1:] != row[:-1])
    begin = np.flatnonzero(begins)
    behind = full.copy()
    behind[:-1] &= ~full[1:] | (row[1:] != row[:-1])
    end = np.flatnonzero(behind) + 1
    line = np.flatnonzero(full)
    limit = np.repeat(end, end - begin)
    parts = [(line[line + k <= limit], line[line + k <= limit] + k) for k in SPANS]
    long = (end - begin > 1) & ~np.isin(end - begin, SPANS)
    parts.append((begin[long], end[long]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _line_blocks(lines: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(first line, line behind) of runs of lines of about ``size`` bytes, or one longer line."""
    i, n = 0, len(lines) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(lines, lines[i] + size, "right")) - 1)
        yield i, j
        i = j


def _likely(model: Model, data: np.ndarray, lines: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first line, line behind, class, probability) of those stretches that may be a family's and probably are."""
    none = (a[:0], a[:0], a[:0], np.zeros(0))
    if not len(a):
        return none
    low, high = int(a.min()), int(b.max())
    words = Words.of(data[lines[low] : lines[high]], lines[low : high + 1] - lines[low], model)
    a, b = a - low, b - low
    share = 1 / np.sqrt(2 * (words.first[b] - words.first[a]) - 1)
    lead, most = model.leads()
    may = words.sums(lead, a, b) * share + most >= -1e-6
    a, b, share = a[may], b[may], share[may]
    if not len(a):
        return none
    p = model.probabilities(words.sums(model.weight, a, b) * share[:, None] + model.bias)
    best = p.argmax(axis=1)
    sure = p[np.arange(len(p)), best]
    named = np.flatnonzero((best > 1) & (sure >= CONFIDENT))
    return a[named] + low, b[named] + low, best[named], sure[named]


def _in_parts(lines: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches, some at a time: those that lie in about a chunk of text, or one longer stretch."""
    order = np.argsort(a, kind="stable")
    for long in (False, True):  # stretches of a few lines overlap, whole runs don't
        own = order[(b - a)[order] > max(SPANS)] if long else order[(b - a)[order] <= max(SPANS)]
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(lines[b[own]], lines[a[own[at]]] + tx.CHUNK, "right"))) if long else max(at + 1, int(np.searchsorted(lines[a[own]], lines[a[own[at]]] + tx.CHUNK, "right")))
            yield own[at:to]
            at = to


def _wrapped(model: Model, data: np.ndarray, lines: np.ndarray, n: np.ndarray, row: np.ndarray, held: dict[int, set[str]]) -> list[tuple[int, int, str, float]]:
    """(first line, line behind, family, probability) of notices over several lines; ``held`` has the families that lines confirm."""
    a, b = _stretches(n, row)
    if not len(a):
        return []
    a, b, best, sure = (np.concatenate(x) for x in zip(*(_likely(model, data, lines, a[own], b[own]) for own in _in_parts(lines, a, b)), strict=True))
    found = []
    taken = {line: set(families) for line, families in held.items()}
    for x in np.lexsort((a, -sure, b - a)).tolist():
        family, own = CLASSES[best[x]], range(int(a[x]), int(b[x]))
        if any(family in taken.get(line, ()) for line in own):
            continue
        if confirms(family, _tokens(data[lines[own.start] : lines[own.stop]].tobytes().decode("utf-8", "replace"))):
            found.append((own.start, own.stop, family, float(sure[x])))
            for line in own:
                taken.setdefault(line, set()).add(family)
    return found


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lines, words of each line) of the 1- and 2-grams."""
    low = tx.LOWER[data]
    starts, ends, first = tx.words(low, offsets, tx.ALNUM)
    word = tx.run_hashes(low, starts, ends)
    row, at = tx.row_of(first), tx.whole_grams(first, 2)
    telling = _STOP_HASHES[np.minimum(np.searchsorted(_STOP_HASHES, word), len(_STOP_HASHES) - 1)] != word
    at = at[telling[at] | telling[at + 1]] if len(at) else at
    return np.concatenate([word[telling], tx.gram_hashes(word, 2)[at]]), np.concatenate([row[telling], row[at]]), np.diff(first)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights (a row for each) and the biases."""

    known: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def find(self, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        return np.where(self.known[at] == gram, at, -1)

    def logits(self, gram: np.ndarray, line: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = self.find(gram)
        at, line = at[at >= 0], line[at >= 0]
        total = np.stack([np.bincount(line, self.weight[at, k], len(n)) for k in range(len(self.bias))], axis=1)
        return total / np.sqrt(np.maximum(2 * n - 1, 1))[:, None] + self.bias

    def bound(self, gram: np.ndarray, line: np.ndarray, n: np.ndarray) -> np.ndarray:
        """No class is further ahead of ``none`` than this; 0 where none is ahead of it."""
        at = self.find(gram)
        lead, most = self.leads()
        total = np.bincount(line[at >= 0], lead[at[at >= 0]], len(n))
        return np.maximum(total / np.sqrt(np.maximum(2 * n - 1, 1)) + most, 0.0)

    def leads(self) -> tuple[np.ndarray, float]:
        """Each feature's largest advantage of any other class over ``none``, and that of the biases."""
        return (self.weight[:, 1:] - self.weight[:, :1]).max(axis=1), float((self.bias[1:] - self.bias[0]).max())

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(per_class: int = PER_CLASS, steps: int = STEPS, seed: int = 5) -> Model:
    rng = random.Random(seed)
    rows = _examples(rng, per_class)
    rng.shuffle(rows)
    data = np.frombuffer("".join(t for t, _ in rows).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t, _ in rows)])
    gram, line, n = _grams(data, offsets)
    y = np.array([k for _, k in rows])
    apart = np.arange(len(rows)) % 5 == 0
    known = np.unique(gram[~apart[line] & (y[line] > 0)])
    seen = np.searchsorted(known, gram[~apart[line]])
    often = np.bincount(seen[known[np.minimum(seen, len(known) - 1)] == gram[~apart[line]]], minlength=len(known))
    known = known[often >= 5]
    at = np.searchsorted(known, gram)
    at = np.where(known[np.minimum(at, len(known) - 1)] == gram, at, -1)
    use = (at >= 0) & ~apart[line]
    share = 1 / np.sqrt(np.maximum(2 * n - 1, 1))
    classes, target = len(CLASSES), np.eye(len(CLASSES))[y]
    weight, bias = np.zeros((len(known), classes)), np.zeros(classes)
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    a, r = at[use], line[use]
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(r, weight[a, k], len(n)) for k in range(classes)], axis=1) * share[:, None] + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - target) * ~apart[:, None] / (~apart).sum()
        pull = (error * share[:, None])[r]
        slope = np.stack([np.bincount(a, pull[:, k], len(known)) for k in range(classes)], axis=1) + 1e-6 * weight
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        weight -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        bias -= 0.5 * error.sum(axis=0)
    model = Model(known, weight.astype(np.float32), bias, 1.0)
    z, truth = model.logits(gram, line, n)[apart], y[apart]

    def loss(t: float) -> float:
        p = Model(known, weight, bias, t).probabilities(z)
        return float(-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    return Model(known, model.weight, bias, min((0.25 * 1.15**k for k in range(25)), key=loss))


def confirms(family: str, words: list[str]) -> bool:
    """Whether the words hold ``CONFIRMED`` of one of the family's templates, as a common subsequence."""
    joined = set(words)
    for template in _SPELLED[family]:
        want = [w for w in template if w in joined]
        if len(want) < CONFIRMED * len(template) or not joined >= _TELLING[family][template]:
            continue
        best = np.zeros(len(words) + 1, np.int32)
        own = np.array(words)
        for w in template:
            step = np.concatenate([[0], best[:-1] + (own == w)])
            best = np.maximum.accumulate(np.maximum(best, step))
        if best[-1] >= CONFIRMED * len(template):
            return True
    return False


_SPELLED = {family: [tuple(_tokens(t)) for t in texts] for family, texts in TEMPLATES.items()}


def _tell(family: str, template: tuple[str, ...]) -> frozenset[str]:
    """Words that set a template apart from most like ones of the other families: they must be there."""
    rival = [t for f, ts in _SPELLED.items() if f != family for t in ts]
    need: set[str] = set()
    for other in rival:
        common = len(set(template) & set(other))
        if common >= CONFIRMED * len(set(template)):
            need |= set(template) - set(other)
    return frozenset(need)


_TELLING = {family: {t: _tell(family, t) for t in texts} for family, texts in _SPELLED.items()}

_FLAG = pa.list_(pa.struct([("paragraph", pa.int64()), ("lines", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))
_FLAG_SQL = "array<struct<paragraph:bigint,lines:bigint,family:string,probability:double,confirmed:boolean>>"


def _flag_lines(m: Model, data: np.ndarray, lines: np.ndarray, a: int, b: int, n: np.ndarray) -> list[tuple[int, int, str, float, bool]]:
    """(line, line behind, family, probability, confirmed) of the flagged ones of lines a to b - 1, whose words it counts in ``n``."""
    gram, line, n[a:b] = _grams(data[lines[a] : lines[b]], lines[a : b + 1] - lines[a])
    size = n[a:b]
    some = np.flatnonzero((m.bound(gram, line, size) > 0) & (size > 0))
    place = np.full(b - a, -1)
    place[some] = np.arange(len(some))
    mine = place[line] >= 0
    p = m.probabilities(m.logits(gram[mine], place[line[mine]], size[some]))
    flagged = []
    for x, best in zip(np.flatnonzero(p.argmax(axis=1) > 0).tolist(), p.argmax(axis=1)[p.argmax(axis=1) > 0].tolist(), strict=True):
        at = int(some[x]) + a
        family, sure = CLASSES[best], float(p[x, best])
        if family != "unknown" and sure < CONFIDENT:
            family = "unknown"
        held = family != "unknown" and confirms(family, _tokens(data[lines[at] : lines[at + 1]].tobytes().decode("utf-8", "replace")))
        flagged.append((at, at + 1, family, sure, held))
    return flagged


def _scanner(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            flags: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            counts = []
            for i, _, data, offsets in tx.slices(batch.column(1)):
                lines = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
                if len(lines) < 2:
                    counts.append(np.zeros(len(offsets) - 1, np.int64))
                    continue
                n = np.zeros(len(lines) - 1, np.int64)
                flagged: list[tuple[int, int, str, float, bool]] = []
                for a, b in _line_blocks(lines, tx.CHUNK):
                    flagged += _flag_lines(m, data, lines, a, b, n)
                row = np.searchsorted(offsets, lines[:-1], "right") - 1
                counts.append(np.bincount(row, n > 0, len(offsets) - 1).astype(np.int64))
                order = np.concatenate([[0], np.cumsum(n > 0)])
                begin = np.searchsorted(lines, offsets[row])  # the first line of each line's row
                wrapped = _wrapped(m, data, lines, n, row, {at: {family} for at, _, family, _, held in flagged if held})
                inside = {at for a, b, _, _ in wrapped for at in range(a, b)}
                flagged = [f for f in flagged if f[4] or f[0] not in inside] + [(*w, True) for w in wrapped]
                for at, behind, family, sure, held in sorted(flagged):
                    flags[i + int(row[at])].append({"paragraph": int(order[at] - order[begin[at]]), "lines": behind - at, "family": family, "probability": sure, "confirmed": held})
            n_lines = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(flags, _FLAG)], ["row", "n_paragraphs", "flagged"])

    return run


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(row, n_paragraphs, flagged): each flagged paragraph's number, lines, family, calibrated probability and confirmation."""
    _store.bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model or train())
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string"))
    return source.mapInArrow(_scanner(shipped), f"row {source.schema['row'].dataType.simpleString()}, n_paragraphs long, flagged {_FLAG_SQL}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sure = F.filter("flagged", lambda x: x["confirmed"])
    return found.select(
        "row.doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licences"),
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("flagged") - F.size(sure)).cast("long").alias("n_unknown"),
        F.round(F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)), 4).alias("probability"),
    )
